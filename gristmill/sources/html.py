"""Rows of HTML pages by a small part of CSS: ``tag``, ``.class``, ``#id``, ``[attr]``, ``[attr=value]`` and descent.

Python inside tasks, page by page; Spark deals out the pages and takes the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import collapse_whitespace

#: Rows of a page at most.
MOST_ROWS = 2000
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_PART = re.compile(r"([.#]?)([A-Za-z0-9_-]+)|\[([A-Za-z0-9_-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self, without: str = "") -> str:
        """Texts below this node, a space apart, but those under ``without``."""
        out, stack = [], [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                if at.strip():
                    out.append(at.strip())
            elif not (without and at is not self and at.matches(without)):
                stack.extend(reversed(at.children))
        return " ".join(" ".join(out).split())

    def matches(self, compound: str) -> bool:
        for kind, name, attr, value in _PART.findall(compound):
            if attr:
                if attr not in self.attrs or (value and self.attrs[attr] != value):
                    return False
            elif kind == "." and name not in self.attrs.get("class", "").split() or kind == "#" and self.attrs.get("id") != name or not kind and self.tag != name.lower():
                return False
        return True

    def select(self, selector: str) -> Iterator[Node]:
        """Nodes below this one that fit, in order of the page."""
        *above, last = selector.split()
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            at = stack.pop()
            if at.matches(last) and at._under(above, self):
                yield at
            stack.extend(c for c in reversed(at.children) if isinstance(c, Node))

    def _under(self, above: list[str], top: Node) -> bool:
        left, up = list(above), self.parent
        while left and up is not None and up is not top:
            if up.matches(left[-1]):
                left.pop()
            up = up.parent
        return not left or (up is not None and len(left) == 1 and up.matches(left[0]))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def tree(page: str) -> Node:
    made = _Tree()
    made.feed(page)
    made.close()
    return made.root


def value(node: Node, selector: str, base: str = "", without: str = "") -> str:
    """A field of a row: ``css`` its text, ``css::attr(a)`` an attribute, made absolute with ``base``, and of a link's
    last segment ``name_id`` with ``::slug(a)`` the name as a title and with ``::slugid(a)`` the id. No css: the row."""
    css, mode, attr = (re.match(r"^(.*?)(?:::(attr|slug|slugid)\(([^)]*)\))?$", selector).groups() + ("",))[:3]
    found = node if not css else next(node.select(css), None)
    if found is None:
        return ""
    if mode is None:
        return found.text(without)
    raw = found.attrs.get(attr, "")
    if mode == "attr":
        return urljoin(base, raw) if raw and base else raw
    tail = re.split(r"[?#]", raw)[0].rstrip("/").rsplit("/", 1)[-1]
    slug, _, ident = tail.rpartition("_")
    slug, ident = (slug, ident) if slug else (tail, tail)
    return ident if mode == "slugid" else slug.replace("-", " ").strip().title()


def html_rows(payloads: DataFrame, row: str, fields: dict[str, str], *, base: str = "", without: str = "", payload_col: str = "payload") -> DataFrame:
    """One row for each part of a page that ``row`` selects, at most MOST_ROWS a page, with a text column for each of
    ``fields`` and ``at``, its place; other columns of ``payloads`` pass through. A null page has no rows."""
    kept = [f for f in payloads.schema.fields if f.name != payload_col]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "at int", *(f"`{k}` string" for k in fields)])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, rest in zip(batch[payload_col], batch[names].itertuples(index=False, name=None), strict=True):
                for at, node in zip(range(MOST_ROWS), tree(page or "").select(row)):
                    out.append((*rest, at, *(value(node, css, base if k == "url" else "", without) for k, css in fields.items())))
            yield pd.DataFrame(out, columns=[*names, "at", *fields])

    return payloads.select(*names, payload_col).mapInPandas(parse, schema)


# Where the boards that are only HTML keep their fields.
JOBVITE = {"row": "table.jv-job-list tbody tr", "title": "td.jv-job-list-name", "url": "td.jv-job-list-name a::attr(href)", "onclick": "::attr(onclick)", "location": "td.jv-job-list-location"}
JOBBANK = {"row": "article", "id": "::attr(id)", "title": ".noctitle", "intern": ".jobinternshipflag", "student": ".jobstudentflag", "company": ".business", "location": ".location"}
ESPRESSO = {
    "row": "div.job_index-content_list_item", "id": "::attr(id)", "slug": "::attr(data-slug)", "title": "h2.job_index-content_list_item-title", "badge": "p.job_index-content_list_item_infos-type",
    "company": "p.job_index-content_list_item-company", "city": "div.job-location-info::attr(data-city)", "province": "div.job-location-info::attr(data-province)",
}


def _rows(payloads: DataFrame, form: dict[str, str], base: str, payload_col: str, without: str = "") -> DataFrame:
    return html_rows(payloads, form["row"], {k: v for k, v in form.items() if k != "row"}, base=base, without=without, payload_col=payload_col)


def parse_jobvite(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Rows of a board's table with ``whole``: false on pages that hide the rest of a category behind a row without a
    name, which may close nothing. A row's link may stand in its onclick."""
    base = "https://jobs.jobvite.com/"
    rows = _rows(payloads, JOBVITE, base, payload_col)
    clicked = F.regexp_extract("onclick", r"location\.href\s*=\s*['\"]([^'\"]{1,300})['\"]", 1)
    link = F.coalesce(F.nullif("url", F.lit("")), F.when(clicked.startswith("http"), clicked).when(clicked != "", F.concat(F.lit(base), F.regexp_replace(clicked, "^/+", ""))))
    rest = [c for c in payloads.columns if c != payload_col]
    from pyspark.sql import Window as W

    hidden = F.bool_or(F.col("title") == "").over(W.partitionBy(*rest)) if rest else F.col("title") == ""
    marked = rows.withColumn("whole", ~hidden).withColumn("url", link)
    return marked.filter("title <> '' and url is not null").withColumn("native_id", F.regexp_extract(F.regexp_replace("url", r"\?.*$|/+$", ""), "([^/]+)$", 1)).drop("onclick", "at")


def parse_jobbank(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Articles flagged for interns or students, each id once, the first by place."""
    rows = _rows(payloads, JOBBANK, "", payload_col, ".wb-inv").withColumn("native_id", F.regexp_extract("id", r"^article-(\d+)$", 1))
    flagged = rows.withColumn("employment_type", F.lower(F.coalesce(F.nullif("intern", F.lit("")), "student"))).filter("native_id <> '' and title <> '' and employment_type <> ''")
    first = flagged.groupBy("native_id").agg(F.min(F.struct("at", "title", "company", "location", "employment_type")).alias("r")).select("native_id", "r.*").drop("at")
    plain = first.withColumn("company", F.coalesce(F.nullif("company", F.lit("")), F.lit("Job Bank"))).withColumn("location", F.coalesce(F.nullif("location", F.lit("")), F.lit("Canada")))
    return plain.withColumn("url", F.concat(F.lit("https://www.jobbank.gc.ca/jobsearch/jobposting/"), "native_id"))


def parse_espresso(payloads: DataFrame, badge: str, payload_col: str = "payload") -> DataFrame:
    """Items that carry ``badge``, each id once, the first by place."""
    rows = _rows(payloads, ESPRESSO, "", payload_col).filter((F.lower("badge") == badge) & (F.col("id") != "") & (F.col("slug") != "") & (F.col("title") != ""))
    first = rows.groupBy(F.col("id").alias("native_id")).agg(F.min(F.struct("at", "slug", "title", "company", "city", "province", "badge")).alias("r")).select("native_id", "r.*")
    place = F.array_join(F.filter(F.array("city", "province", F.lit("Canada")), lambda x: x != ""), ", ")
    return first.select("native_id", "title", F.coalesce(F.nullif("company", F.lit("")), F.lit("Espresso-Jobs")).alias("company"), collapse_whitespace(place).alias("location"), F.lower("badge").alias("employment_type"), F.concat(F.lit("https://www.espresso-jobs.com/emploi/"), "native_id", F.lit("/"), "slug").alias("url"))
