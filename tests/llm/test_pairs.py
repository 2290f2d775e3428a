"""Operators between texts, vectors, pages and messages, and the pipeline."""

import hashlib
import math
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import TEXTS, docs, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from quizmill.llm import components, jaccard, lattice, pages, quotes, shingles, suffixes  # noqa: E402


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    pick = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(pick.randrange(100, 160), pick.randrange(100, 160)) for _ in range(40)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = roots({x for p in pairs for x in p}, pairs)
    own = {a for a, b in pairs if a != b} | {b for a, b in pairs if a != b}
    assert {r.node: r.component for r in got} == {n: want[n] for n in own} and len(got) == len(own)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_jaccard(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    pairs = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and 100 * len(a & b) >= 80 * len(a | b):
                pairs.append((i, j))
    return roots({i for i, _ in sets}, pairs)


def near_family(seed, size, edits):
    base, pick = words(200, seed), random.Random(seed)
    for _ in range(size):
        own = list(base)
        for _ in range(pick.randint(0, edits)):
            own[pick.randrange(len(own))] = f"new{pick.randrange(10**6)}"
        yield " ".join(own)


def test_jaccard_matches_brute_force(spark):
    rows = TEXTS[:-4] + [(200 + k, t) for k, t in enumerate([*near_family(1, 25, 6), *near_family(2, 12, 5)])]
    rows += [(300 + n, " ".join(words(n, 9))) for n in range(1, 30)]
    got = jaccard.classify(docs(spark, rows)).collect()
    want = brute_jaccard(rows)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t)) for i, t in rows}


def test_jaccard_of_odd_rows(spark):
    got = jaccard.classify(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.classify(docs(spark, [])).count() == 0


def test_keys_of_every_linking_pair_meet():
    """Pairs at the limit, also of tiny sets with empty groups, share a key."""
    pick = np.random.default_rng(4)
    for n in [*range(1, 40), 100, 350]:
        for _ in range(6):
            one = pick.integers(1, 1 << 62, n).astype(np.uint64)
            change = (n * 20) // 180  # as many as similarity 0.8 allows when replaced
            two = np.unique(np.concatenate([one[change:], pick.integers(1, 1 << 62, change).astype(np.uint64)]))
            one = np.unique(one)
            common = len(np.intersect1d(one, two))
            if 100 * common >= 80 * (len(one) + len(two) - common):
                assert len(np.intersect1d(jaccard.keys(one), jaccard.keys(two)))


def test_shingle_counts():
    texts = [(t or "").encode() for _, t in TEXTS]
    assert [len(s) for s in shingles.shingle_sets(texts)] == [len(shingle_set(t)) for _, t in TEXTS]


def brute_repeats(rows):
    first, out = {}, {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            key = raw[p : p + 50]
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


def test_repeats_match_brute_force(spark):
    rows = TEXTS[:-4] + [(200 + k, t) for k, t in enumerate(near_family(3, 12, 8))] + [(300, "é" * 60), (301, "x" + "é" * 60)]
    got = suffixes.remove_repeats(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in got} == brute_repeats(rows)
    assert all(r.rest.score == 7 for r in got) and len(got) == len(rows)


def test_repeats_of_odd_rows(spark):
    got = suffixes.remove_repeats(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_merge_of_front_coded_runs():
    pick = np.random.default_rng(5)
    runs = []
    for n in (1, 5, 40, 0, 17):
        m = pick.integers(97, 99, (n, suffixes.WIDTH)).astype(np.uint8)
        m[:, 12:] = 97
        m = np.unique(m, axis=0)
        runs.append((m, suffixes.Run(suffixes.front_code(m, np.arange(len(m))))))
    _, _, shared, texts = suffixes.merge([r for _, r in runs])
    want = sorted(x.tobytes() for m, _ in runs for x in m)
    assert texts == want
    for k in range(1, len(want)):
        a, b = want[k - 1], want[k]
        assert shared[k] == next((i for i in range(suffixes.WIDTH) if a[i] != b[i]), suffixes.WIDTH)


def brute_links(rows, least=0.95):
    good = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    pairs = [
        (i, j) for i in good for j in good
        if i < j and len(good[i]) == len(good[j]) and float(good[i] @ good[j]) >= least
    ]
    counts = {i: sum(i in p for p in pairs) for i, _ in rows}
    return counts, roots({i for i, _ in rows}, pairs)


@pytest.mark.parametrize("cell", [2000, 20])
def test_lattice_matches_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(lattice, "CELL", cell)
    pick = np.random.default_rng(6)
    rows, centres = [], pick.standard_normal((12, 64))
    for k in range(150):
        v = centres[k % 12] if k % 3 else pick.standard_normal(64)
        rows.append((k, (v + 0.08 * pick.standard_normal(64)).tolist()))
    rows += [(900 + k, rows[1][1]) for k in range(5)] + [(950, [2 * x for x in rows[1][1]])]
    odd = [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] * 64, [1.0, 2.0], [1.0, 2.0]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, links int")
    got = lattice.near_duplicates(table).collect()
    counts, parts = brute_links(rows)
    assert {r.vec_id: r.component_id for r in got} == parts
    assert {r.vec_id: r.n_links for r in got} == counts and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_lattice_of_an_empty_table(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_e8_finds_the_nearest_point():
    pick = np.random.default_rng(8)
    x = pick.uniform(-1, 1, (200, 8))
    near, other = lattice.e8(x)
    for p in (near, other):
        twice = np.rint(p * 2).astype(int)
        assert (twice / 2 == p).all() and (p.sum(1) % 2 == 0).all()
        assert all(len({t % 2 for t in row}) == 1 for row in twice.tolist())
    steps = pick.integers(-1, 2, (500, 8)).astype(float)
    steps = steps[steps.sum(1) % 2 == 0]
    best = ((x - near) ** 2).sum(1)
    for s in steps:
        assert (((x - near - s) ** 2).sum(1) >= best - 1e-9).all()


PAGE = (
    "<!DOCTYPE html><html><head><title>T{k}</title><style>p{{x}}</style><script>var a='</p>';</script></head><body>"
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy {k}</div>"
    "<header>Site</header><div id='cookie-notice'>We use cookies</div>"
    "<article><h1>Head {k}</h1><p>First   &amp; best {k}<br>next<p>Second&nbsp;{k} &eacute;</p><form>Name <input></form>"
    "<aside>See also</aside></article><section class='comments'><p>me too {k}</p></section><footer>&copy; x</footer></body></html>"
)


def test_pages(spark):
    rows = [(k, f"https://a.example/{k}", PAGE.format(k=k)) for k in range(8)]
    rows += [(100, "https://b.example/", PAGE.format(k=100)), (101, None, None), (102, "x", ""), (103, "https://a.example/z", "<p>only <b>this")]
    rows += [rows[0]]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, main string")
    got = pages.extract(table).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    for k in [*range(8), 100]:
        assert texts[k] == f"Head {k}\nFirst & best {k} next\nSecond {k} é"
    assert texts[101] == texts[102] == "" and texts[103] == "only this"
    assert pages.extract(table.where("false")).count() == 0


def test_pages_lose_their_hosts_constant_texts(spark):
    page = (
        "<html><body><div id='post-{k}'><p>Filed in general, as always</p><p>Own words {k}, {w}</p><p>More of the {k}: {w}</p></div>"
        "<div>Foot</div></body></html>"
    )
    rows = [(k, f"https://c.example/{k}", page.format(k=k, w=" ".join(words(30, k)))) for k in range(8)]
    rows += [(100 + k, f"https://c.example/copy{k}", rows[0][2]) for k in range(20)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = pages.extract(table).collect()
    for r in got:
        k = r.page_id if r.page_id < 100 else 0
        assert [x.split(",")[0].split(":")[0] for x in r.text.split("\n")] == [f"Own words {k}", f"More of the {k}"]
    found = pages.templates(table, "page_id", "url", "html").first()
    one = {x["path"]: x["class"] for x in found.template if x["text"] is None}
    assert one["/html"] == one["/html/body"] and found.main == "/html/body/div.post-0"
    assert {x["class"] for x in found.template if x["text"] is not None} == {one["/html"]}
    assert {x["within"] for x in found.template if x["path"].endswith("/p") and x["text"] is None} == {one["/html"]}


def test_quotes(spark):
    rows = [
        (1, "Hello all\nsecond line", "a"), (2, "> Hello all\n> second line\nFine.", "b"),
        (3, ">> Hello all\n>> second line\n> Fine.\nAnd you?", "a"), (4, "> second   LINE\nI saw that", "c"),
        (5, "Hello all\nsecond line", "d"), (6, "> nobody said this\nhm", "e"), (7, None, "f"), (8, "", "g"),
        (9, "> And you?\n\n> Fine.\nboth", "h"),
    ]
    table = spark.createDataFrame(rows, "message_id long, text string, position string")
    got = {r.message_id: r for r in quotes.conversations(table).collect()}
    assert [got[k].reply_to for k in range(1, 10)] == [None, 1, 2, 1, None, None, None, None, 2]
    assert [got[k].conversation for k in range(1, 10)] == [1, 1, 1, 1, 5, 6, 7, 8, 1]
    order = sorted((r.position, k) for k, r in got.items() if r.conversation == 1)
    assert order == [(0, 1), (1, 2), (2, 4), (3, 3), (4, 9)]
    assert got[3].text == "And you?" and got[7].text == "" and got[1].text == rows[0][1]
    assert quotes.conversations(table.where("false")).count() == 0


@pytest.mark.parametrize("common", [0, 1, 100])
def test_votes_count_all_who_said_a_line(spark, monkeypatch, common):
    monkeypatch.setattr(quotes, "COMMON", common)
    rows = [(1, "line a\none"), (2, "line a\ntwo"), (7, "line a\nline b"), (8, "> line a\n> x\n-\n> line b\nYes."), (9, "line b\nline a\nline c")]
    rows += [(10, "> line a\n> line b\n> line c\n> y\nNo."), (11, "line b"), (12, "> line b\nOh.")]
    pick = random.Random(5)
    for k in range(20, 120):
        said = [f"say {pick.randrange(12)}" for _ in range(pick.randint(1, 4))]
        rows.append((k, "\n".join([f"> say {pick.randrange(12)}" for _ in range(pick.randint(0, 4))] + said)))
    texts = {i: [x for x in t.split("\n")] for i, t in rows}
    whole = {i: " ".join(x for x in t if x[0] != ">") for i, t in texts.items()}
    want = {}
    for i, t in texts.items():
        asked = {x[2:] for x in t if x[0] == ">"}
        passages = {" ".join(x[2:] for x in p.split("\n") if x) for p in re.split(r"(?m)^[^>].*$", "\n".join(t)) if p.strip()}
        votes = [(whole[j] not in passages, -len(asked & {x for x in texts[j] if x[0] != ">"}) - (whole[j] in passages), j) for j in texts if j < i]
        want[i] = min((v for v in votes if v[1] < 0), default=(0, 0, None))[2]
    assert want[8] == 7 and want[10] == 9 and want[12] == 11
    got = quotes.conversations(spark.createDataFrame(rows, "message_id long, text string")).collect()
    assert {r.message_id: r.reply_to for r in got} == want


def test_long_reply_chain(spark):
    rows = [(k, (f"> say {k - 1}\n" if k else "") + f"say {k}") for k in range(40)]
    got = quotes.conversations(spark.createDataFrame(rows, "message_id long, text string")).collect()
    assert {(r.message_id, r.conversation, r.position) for r in got} == {(k, 0, k) for k in range(40)}


def test_pipeline_keeps_columns_and_acts(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    kept = rows.limit(120).cache()
    near = corpus_pipeline.drop_near_copies(spark, kept, sf)
    want = brute_jaccard([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted({v for v in want.values()})
    cut = corpus_pipeline.cut_repeats(spark, kept, sf)
    brute = brute_repeats([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id: r.text for r in cut.collect()} == {i: b[4] for i, b in brute.items()}
    assert near.columns == cut.columns == kept.columns
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (corpus_pipeline.clean_toxicity, corpus_pipeline.clean_quality):
        out = stage(spark, rows, sf)
        assert out.columns == rows.columns and 0.5 * rows.count() < out.count() < rows.count()


def test_filters_keep_rows_without_an_id(spark):
    rows = docs(spark)
    near = corpus_pipeline.drop_near_copies(spark, rows, "")
    assert near.where("doc_id is null").count() == 1 and near.columns == rows.columns
    assert corpus_pipeline.cut_repeats(spark, rows, "").where("doc_id is null").count() == 1


def test_filters_act_on_rows_without_or_with_repeated_ids(spark):
    other = "quite another text of some words that is near to nothing else at all"
    rows = [(None, TEXTS[0][1]), (None, TEXTS[0][1]), (5, other), (5, other), (5, "x y z"), (4, "a b c"), (6, "a b c"), (None, "a b c")]
    near = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "")
    got = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    assert got == sorted([(None, TEXTS[0][1]), (5, other), (5, "x y z"), (4, "a b c")], key=str)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.clean_quality(spark, given, "")
    without = corpus_pipeline.clean_quality(spark, given.withColumn("doc_id", F.lit(None).cast("bigint")), "")
    same = corpus_pipeline.clean_quality(spark, given.withColumn("doc_id", F.lit(1).cast("bigint")), "")
    want = sorted(str(r.text) for r in kept.collect())
    assert 0 < len(want) < given.count()
    assert sorted(str(r.text) for r in without.collect()) == sorted(str(r.text) for r in same.collect()) == want


def test_stages_keep_clashing_columns_and_free_what_is_left(spark, tmp_path):
    from pathlib import Path

    from quizmill.storage import group_path

    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    extra = {"score": F.lit(7), "passages": F.lit("p"), "_row": F.col("doc_id") * 2, "own": F.lit(1), "block": F.lit(2)}
    given.withColumns(extra).write.parquet(str(tmp_path / "0"))
    rows, made = spark.read.parquet(str(tmp_path / "0")), Path(group_path(spark, corpus_pipeline.SCRATCH))
    before: set[str] = set()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4], 1):
        out = stage(spark, rows, sf)
        now = {p.name for p in made.glob("*")}
        assert not now & before
        before = now
        out.write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        assert rows.columns == given.columns + list(extra)
        assert rows.where("score <> 7 or passages <> 'p' or _row <> doc_id * 2 or own <> 1 or block <> 2").count() == 0
    assert 0 < rows.count() < 150
