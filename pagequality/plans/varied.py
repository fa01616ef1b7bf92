"""The corpus tables with addresses, markup and phrases that make the rules fire.

Every row of ``pages`` and ``documents`` is read; its id decides what is
changed about it, so hosts, extensions, paths, page numbers, failed fetches,
code, comments, trackers and phrases vary over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Views

#: Address of a page by ``page_id % 24``; other remainders keep their own.
ADDRESSES = (
    (0, "https://www.linkedin.com/{lang}/in/p{id}?page={page}"),
    (1, "https://files.open-data.org/{lang}/a/{id}.pdf?page={page}"),
    (2, "https://www.youtube.com/watch?v=v{id10}"),
    (3, "https://youtu.be/w{id10}"),
    (4, "https://www.reddit.com/{lang}/comments/{id}/?page={page}"),
    (5, "https://lab.physics.edu/{lang}/wiki/{id}?page={page}"),
    (6, "https://best-cheap-deals-guide.xyz/{lang}/blog/{id}?page={page}"),
    (7, "https://daily2024.com/{lang}/article/{id}?page={page}"),
    (8, "https://averyveryverylongnameforonesinglehost.com/{lang}/docs/{id}?page={page}"),
    (9, "https://code.example.net/{lang}/blob/{id}?page={page}"),
    (10, "https://ask.example.org/{lang}/questions/{id}?page={page}"),
    (11, "https://www.example-store.co.uk/{lang}/product/{id}?page={page}"),
    (12, "https://192.168.0.1/{lang}/{id}?page={page}"),
    (13, "https://m.facebook.com/{lang}/{id}?page={page}"),
    (14, "https://open.gov.uk/{lang}/{id}.ZIP?page={page}"),
)
#: 24 ids in a row share a made-up language of two letters, and so a query, of this many pages.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAGES_PER_QUERY = 3

#: Appended to a page's html by ``page_id % 7``; at EMPTY the fetch failed and there is none.
MARKUP = (
    (0, "<pre >a = 1</pre><code >b = 2</code>"),
    (1, '<div class="comment">one</div><div class="comment">two</div><div class="user comment">three</div>'),
    (2, '<script src="analytics.js"></script><script>gtag(); googletag.cmd; doubleclick; hotjar</script>'),
    (4, "<p>In conclusion, let's dive into a game changer. It's important to note this.</p>"),
    (5, "<p>anna wrote: yes. ben replied, carl says 12 points) and an upvote</p>"),
)
EMPTY = 3

#: Appended to a document's text by ``doc_id % 5``.
PHRASES = (
    (0, " In conclusion, let's dive into this game changer. It's important to note that we delve into it."),
    (1, " anna wrote: yes. ben replied, carl says no, 12 points) and an upvote"),
)


def _by_id(key: Column, n: int, cases, default: Column) -> Column:
    out = None
    for k, value in cases:
        out = F.when(key % n == k, value) if out is None else out.when(key % n == k, value)
    return out.otherwise(default)


def _address(template: str) -> Column:
    key = F.col("page_id")
    lang = F.expr(f"concat(substr('{LETTERS}', int(page_id div 24 % 26) + 1, 1), substr('{LETTERS}', int(page_id div {24 * 26} % 26) + 1, 1))")
    page = (key % PAGES_PER_QUERY + 1).cast("string")
    out = F.lit(template)
    for name, value in (("{lang}", lang), ("{page}", page), ("{id10}", F.lpad(key.cast("string"), 10, "0")),
                        ("{id}", key.cast("string"))):
        if name in template:
            out = F.replace(out, F.lit(name), value)
    return out


def varied_pages(pages: DataFrame) -> DataFrame:
    key = F.col("page_id")
    url = _by_id(key, 24, [(k, _address(t)) for k, t in ADDRESSES], F.col("url"))
    html = _by_id(key, 7, [(k, F.concat("html", F.lit(t))) for k, t in MARKUP] + [(EMPTY, F.lit(""))], F.col("html"))
    return pages.withColumns({"url": url, "html": html})


def varied_documents(documents: DataFrame) -> DataFrame:
    text = _by_id(F.col("doc_id"), 5, [(k, F.concat("text", F.lit(t))) for k, t in PHRASES], F.col("text"))
    return documents.withColumn("text", text)


def varied(sf_dir: str) -> Views:
    """The tables of ``sf_dir``, ``pages`` and ``documents`` varied."""
    return Views.of(sf_dir, pages=varied_pages, documents=varied_documents)
