"""HTML structure signals and text extraction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .text import count_contained

# Fixed extraction rules (own definition of "main text"):
DROP_BLOCK_TAGS = ("script", "style", "head", "nav", "footer", "aside")
BLOCK_TAG_RE = r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|tr|table|article|section|blockquote|pre)([\s/][^>]*)?>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _drop_noise(html: Column) -> Column:
    s = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROP_BLOCK_TAGS:
        s = F.regexp_replace(s, rf"(?is)<{tag}[\s>].*?</{tag}>", "")
    return s


def _unescape(s: Column) -> Column:
    for ent, ch in ENTITIES:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return s


def _squeeze(s: Column) -> Column:
    s = F.regexp_replace(s, r"[ \t]+", " ")
    s = F.regexp_replace(s, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(s, r"^[ \n]+|[ \n]+\z", "")


def extract_text(html: Column) -> Column:
    """Main text of a page: comments and script/style/head/nav/footer/aside
    blocks removed, block tags become line breaks, other tags vanish,
    entities are unescaped and blank runs squeezed.  NULL for empty html."""
    s = _drop_noise(html)
    s = F.regexp_replace(s, BLOCK_TAG_RE, "\n")
    s = F.regexp_replace(s, r"<[^>]*>", "")
    s = _squeeze(_unescape(s))
    return F.when(F.coalesce(F.length(html), F.lit(0)) > 0, s)


def html_to_markdown(html: Column) -> Column:
    """Readable markdown of the main content: ATX headings, list dashes,
    bold, links and inline code are kept; images, scripts and styles go."""
    s = _drop_noise(html)
    s = F.regexp_replace(s, r"(?i)<img[^>]*>", "")
    for level in range(1, 7):
        s = F.regexp_replace(s, rf"(?is)<h{level}(\s[^>]*)?>(.*?)</h{level}>", "\n\n" + "#" * level + " $2\n\n")
    s = F.regexp_replace(s, r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", r"[$2]($1)")
    s = F.regexp_replace(s, r"(?i)</?(b|strong)(\s[^>]*)?>", "**")
    s = F.regexp_replace(s, r"(?i)</?(i|em)(\s[^>]*)?>", "*")
    s = F.regexp_replace(s, r"(?i)</?code(\s[^>]*)?>", "`")
    s = F.regexp_replace(s, r"(?i)<li(\s[^>]*)?>", "\n- ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, BLOCK_TAG_RE, "\n\n")
    s = F.regexp_replace(s, r"<[^>]*>", "")
    s = _unescape(s)
    s = F.regexp_replace(s, r"[ \t]+", " ")
    s = F.regexp_replace(s, r" *\n *", "\n")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.when(F.coalesce(F.length(html), F.lit(0)) > 0,
                  F.regexp_replace(s, r"^[ \n]+|[ \n]+\z", ""))


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_signals_struct(html: Column, text: Column, params: Params = DEFAULT) -> Column:
    """Structure signals of one page; ``html`` should already be lower-cased
    by the caller only for the counts -- nav ratio divides by the original
    length, which lower-casing keeps for these inputs."""
    hl = F.lower(html)
    code = F.regexp_count(hl, F.lit(r"<code[\s>]")) + F.regexp_count(hl, F.lit(r"<pre[\s>]"))
    article = F.instr(hl, "<article") > 0
    comments = F.regexp_count(hl, F.lit(r"class=\"[^\"]*comment[^\"]*\""))
    links = F.regexp_count(hl, F.lit(r"<a[\s>]"))
    text_len = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))
    density = links.cast("double") / (text_len.cast("double") / F.lit(100.0))
    nav_len = F.aggregate(F.regexp_extract_all(hl, F.lit(r"(?s)<nav[\s>].*?</nav>"), 0),
                          F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    nav_ratio = nav_len.cast("double") / F.greatest(F.length(html), F.lit(1)).cast("double")
    ads = count_contained(hl, params.ad_trackers)
    return F.struct(code.alias("code_blocks"), article.alias("article"), comments.alias("comments"),
                    links.alias("links"), density.alias("density"), nav_len.alias("nav_len"),
                    nav_ratio.alias("nav_ratio"), ads.alias("ad_scripts"))


def html_points(h: Column) -> Column:
    """Points and flags from a struct produced by :func:`html_signals_struct`."""
    p_code = F.when(h["code_blocks"] >= 2, 10).when(h["code_blocks"] == 1, 5).otherwise(0)
    p_art = F.when(h["article"], 3).otherwise(0)
    p_com = F.when(h["comments"] >= 3, 5).otherwise(0)
    p_den = F.when(h["density"] > 3.0, -10).when(h["density"] > 2.0, -5).otherwise(0)
    p_nav = F.when((h["nav_len"] > 0) & (h["nav_ratio"] > 0.3), -5).otherwise(0)
    p_ad = F.when(h["ad_scripts"] >= 4, -5).otherwise(0)
    flags = F.array_compact(F.array(
        F.when(h["code_blocks"] >= 1, F.lit("has_code")),
        F.when(h["article"], F.lit("has_article_tag")),
        F.when(h["comments"] >= 3, F.lit("has_comments")),
        F.when(h["density"] > 3.0, F.lit("high_link_density")),
        F.when((h["nav_len"] > 0) & (h["nav_ratio"] > 0.3), F.lit("nav_heavy")),
        F.when(h["ad_scripts"] >= 4, F.lit("ad_heavy")),
    ))
    return F.struct((p_code + p_art + p_com + p_den + p_nav + p_ad).alias("points"), flags.alias("flags"))
