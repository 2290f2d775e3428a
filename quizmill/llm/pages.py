"""Main text of web pages by templates deduced from occurrence vectors.

Pages of one host share a template; copies of a page (equal html) count once. A token is a tag with the
tags around it (names, ids, classes; numbers in them don't count), or such a tag with a text; its
occurrence vector says how often it is on each of the host's pages. Tokens with the same vector form an
equivalence class, told by a sum of hashes over the pages, so no vector is ever gathered. Classes that
are on at least half of the host's pages are valid; each nests in the class of the nearest valid tag
around it, and ``template`` holds them so. The texts of valid classes are the template's own and are
taken out of every page. What lies between template tokens are slots, with how much text they hold, how
much of it is in links, and how much is the same on several pages; text under tags of no valid class
belongs to the slot around it. The article's slots lie in one container: from the root, the walk
goes to the child container that holds most of the text that is neither linked, constant nor in
something else (menus, forms, comments and so on), as long as one child holds nearly all.

All sums per host are aggregations with partial sums; pages meet their host's template in a salted join.
A page without its host's container, or of a host with fewer than ``LEAST`` different pages, is walked
alone. A page that holds nothing but template texts in its container keeps them.

Defined results: a null or empty html, and a page without text, give an empty text; a null url is a host
of its own; repeated rows stay. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html as references
import marshal
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.storage import materialize

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|select|svg|title)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
#: What an article is not, by element, and by words in class, id or role.
OTHER = frozenset("head nav header footer aside form button menu dialog object fieldset".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment"
    " comments consent cookie cookies disclaimer discussion footer header login masthead menu modal nav"
    " navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related"
    " recommended replies reply search share sharing sidebar signup social sponsor sponsored subscribe"
    " toolbar widget".split()
)
LEAST = 3
SALTS = 16


def _name(tag: str, rest: str) -> tuple[str, bool]:
    """A tag's step in a path, and whether it opens something else than an article."""
    words = [w for m in NAMED.findall(rest) for w in m.lower().split()] if rest else []
    other = tag in OTHER or any(p in WORDS for w in words for p in re.split(r"[^a-z]+", w))
    if tag in ("html", "body", "article", "main") and tag not in OTHER:
        other = False
    return re.sub(r"\d+", "0", ".".join([tag, *words[:2]])), other


def blocks(html: str, opened: dict[tuple[str, bool], int] | None = None) -> list[tuple[str, str, int, bool]]:
    """(path, text, characters in links, whether it is in something else) of every block of text.
    ``opened`` gets how often each tag is opened, by path and whether it is in something else."""
    out: list[tuple[str, str, int, bool]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path, other
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                where = next((s for s in reversed(stack) if s[0] not in INLINE), ("", "", False))
                out.append((where[1], text, linked, where[2]))
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[2] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in CONTAINERS:
                    break
        if tag in ("li", "tr", "td", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            stack.pop()
        if tag not in VOID and not m[4].endswith("/"):
            step, other = _name(tag, m[4])
            above = stack[-1] if stack else ("", "", False)
            stack.append((tag, f"{above[1]}/{step}", other or above[2]))
            if opened is not None:
                opened[stack[-1][1:]] = opened.get(stack[-1][1:], 0) + 1
    parts.append(html[at:])
    close()
    return out


def walk(mass: dict[str, float]) -> str:
    """The container of most of the text, from the root down. ``mass``: text by path."""
    sums: dict[str, float] = defaultdict(float)
    for path, n in mass.items():
        steps = path.split("/")
        for k in range(1, len(steps) + 1):
            sums["/".join(steps[:k])] += n
    children: dict[str, list[str]] = defaultdict(list)
    for path in sums:
        if path:
            children[path.rpartition("/")[0]].append(path)
    here = ""
    while True:
        fit = [c for c in children[here] if c.rpartition("/")[2].split(".")[0] in CONTAINERS]
        best = max(fit, key=lambda c: (sums[c], c), default=None)
        # an article in one of several containers beside each other is reached through its share
        if best is None or sums[best] < 0.6 * sums[here]:
            return here
        here = best


def _host(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0]


def _mark(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}") >> 1


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: host, the page's identity, its tags and texts."""
    for batch in batches:
        hosts, names, tokens = [], [], []
        for url, html in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            opened: dict[tuple[str, bool], int] = {}
            texts: dict[tuple, list] = {}
            for path, text, linked, other in blocks(html or "", opened):
                own = texts.setdefault((path, other, _mark(path, text)), [0, 0, 0])
                own[0] += 1
                own[1] += len(text)
                own[2] += min(linked, len(text))
            hosts.append(_host(url))
            names.append(xxhash.xxh128_digest((html or "").encode("utf-8", "surrogatepass")))
            tags = [(path, other, None, n, 0, 0) for (path, other), n in opened.items()]
            tokens.append(marshal.dumps(tags + [(*key, *own) for key, own in texts.items()]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(names, pa.binary()), pa.array(tokens, pa.binary())],
            names=["host", "page", "tokens"],
        )


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token: pages, occurrences, the vector's hash, text, linked text. A tag's text is null;
    a null path counts the host's pages."""
    for batch in batches:
        sums: dict[tuple, list] = {}
        for host, page, tokens in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for path, other, text, n, chars, linked in [(None, False, None, 1, 0, 0), *marshal.loads(tokens)]:
                mark = xxhash.xxh64_intdigest(page + n.to_bytes(8, "little")) >> 24
                own = sums.setdefault((host, path, text, other), [0, 0, 0, 0, 0])
                for k, v in enumerate((1, n, mark, chars, linked)):
                    own[k] += v
        keys, values = list(sums), list(sums.values())
        names = ["host", "path", "text", "other", "pages", "n", "vector", "chars", "linked"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_()] + [pa.int64()] * 5
        columns = [[k[c] for k in keys] for c in range(4)] + [[v[c] for v in values] for c in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


TEMPLATE = "template array<struct<class: int, within: int, path: string, text: long>>"


def _deduce(table: pa.Table) -> pa.Table:
    """Of one host: its template (valid classes of tokens and the class each is within), the template's
    texts and the container of its article slots. Rows with a text are its valid texts."""
    rows = table.to_pylist()
    total = rows[0]["host_pages"]
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for r in rows:
        if r["pages"] and 2 * r["pages"] >= total >= LEAST:
            classes[r["pages"], r["n"], r["vector"]].append(r)
    listed = sorted(
        (sorted(m, key=lambda r: (r["path"].count("/"), r["path"], r["text"] or -1)) for m in classes.values()),
        key=lambda m: (m[0]["path"].count("/"), m[0]["path"], m[0]["text"] or -1),
    )
    tags = {r["path"]: k for k, members in enumerate(listed) for r in members if r["text"] is None}

    def around(path: str) -> str:
        """The path itself or the nearest one around it that is the template's."""
        while path and path not in tags:
            path = path.rpartition("/")[0]
        return path

    template, texts = [], []
    for k, members in enumerate(listed):
        first = members[0]["path"]
        above = around(first if members[0]["text"] is not None else first.rpartition("/")[0])
        within = tags.get(above, -1)
        for r in members:
            template.append({"class": k, "within": within if within != k else -1, "path": r["path"], "text": r["text"]})
            if r["text"] is not None:
                texts.append(r["text"])
    mass: dict[str, float] = defaultdict(float)
    for r in rows:
        free = r["chars"] - r["linked"]
        if r["text"] is None and not r["other"] and free > 0 and 2 * r["constant"] < r["blocks"]:
            mass[around(r["path"])] += free
    main = walk(mass) if mass and total >= LEAST else None
    kind = pa.list_(pa.struct([("class", pa.int32()), ("within", pa.int32()), ("path", pa.string()), ("text", pa.int64())]))
    return pa.table({
        "host": pa.array([rows[0]["host"]]), "main": pa.array([main], pa.string()),
        "texts": pa.array([texts], pa.list_(pa.int64())), "template": pa.array([template], kind),
    })


def templates(pages: DataFrame, page_col: str, url_col: str, html_col: str) -> DataFrame:
    """(host, main, texts, template): the path of the article's container on each host, null where it
    can't be told; the marks of the template's own texts; the nested classes."""
    once = (
        pages.select(url_col, html_col)
        .mapInArrow(_parse, "host string, page binary, tokens binary")
        .groupBy("host", "page").agg(F.first("tokens").alias("tokens"))
    )
    observed = once.mapInArrow(
        _observe,
        "host string, path string, text long, other boolean, pages long, n long, vector long, chars long, linked long",
    )
    kinds = "decimal(38,0)"
    tokens = materialize(
        observed.groupBy("host", "path", "other", "text").agg(
            F.sum("pages").alias("pages"), F.sum("n").alias("n"),
            (F.sum(F.col("vector").cast(kinds)) % F.lit((1 << 62) - 57)).cast("bigint").alias("vector"),
            F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        ),
        "page_tokens",
    )
    hosts = tokens.where("path is null").select("host", F.col("pages").alias("host_pages"))
    tag, text = F.col("text").isNull(), F.col("text").isNotNull()
    paths = tokens.where("path is not null").groupBy("host", "path", "other").agg(
        F.max(F.when(tag, F.col("pages"))).alias("pages"), F.max(F.when(tag, F.col("n"))).alias("n"),
        F.max(F.when(tag, F.col("vector"))).alias("vector"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.sum(F.when(text, F.col("n")).otherwise(0)).alias("blocks"),
        # blocks whose text is on many pages of the host at the same place
        F.sum(F.when(text & (F.col("pages") > 1), F.col("n")).otherwise(0)).alias("constant"),
    ).withColumn("text", F.lit(None).cast("bigint")).join(hosts, "host")
    valid = tokens.where(text & (F.col("pages") >= LEAST)).join(hosts, "host").where("2 * pages >= host_pages")
    rows = paths.unionByName(valid.withColumns({"blocks": F.lit(0).cast("bigint"), "constant": F.lit(0).cast("bigint")}))
    return rows.groupBy("host").applyInArrow(_deduce, f"host string, main string, texts array<long>, {TEMPLATE}")


def extract(
    pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per row: page, url, ``text`` of the article and ``main``, the path that it was found at."""
    found = materialize(templates(pages, page_col, url_col, html_col), "templates")
    salted = found.select(
        "host", F.col("main").alias("_main"), F.col("texts").alias("_texts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    host = F.split(
        F.regexp_replace(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://", ""), "[/?]"
    )[0]
    joined = pages.select(
        page_col, url_col, html_col, host.alias("host"),
        F.pmod(F.xxhash64(page_col, html_col), F.lit(SALTS)).cast("int").alias("_salt"),
    ).join(salted, ["host", "_salt"], "left").select(page_col, url_col, html_col, "_main", "_texts")
    schema = T.StructType(
        [pages.schema[page_col], pages.schema[url_col]]
        + [T.StructField("text", T.StringType()), T.StructField("main", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, mains = [], []
            for html, main, own_texts in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                got = [b for b in blocks(html.as_py() or "") if not b[3]]
                own = main
                if own is None or not any(_inside(path, own) for path, *_ in got):
                    mass: dict[str, float] = defaultdict(float)
                    for path, text, linked, _ in got:
                        mass[path] += max(0, len(text) - linked)
                    own = walk(mass)
                inside = [b for b in got if _inside(b[0], own)]
                constant = set(own_texts.as_py() or ())
                rest = [b for b in inside if _mark(b[0], b[1]) not in constant] if constant else inside
                texts.append("\n".join(b[1] for b in rest or inside))
                mains.append(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(mains, pa.string())], names=schema.names
            )

    return joined.mapInArrow(run, schema)


def _inside(path: str, main: str) -> bool:
    return path == main or path.startswith(main + "/")


def op3_pages(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
