"""Whitening, Merkle manifest and top-k search against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sparkwitness.llm import merkle, topk, whitening
from sparkwitness.llm.registry import queries

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
CLASH = "id long, v string, x int, g int, i int, place int, key int, n int, rank int"
ODD = (7, "v", 1, 2, 3, 4, 5, 6, 7)


# Merkle manifest.

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, source, lang, n_chars, text = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def proof_of(nodes, at):
    """(root, siblings per level, slots) of node ``at``."""
    around = []
    while len(nodes) > 1:
        first = at // 16 * 16
        run = nodes[first:first + 16]
        around.append((run[:at - first], run[at - first + 1:]))
        nodes, at = [sha(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)], at // 16
    return nodes[0], around


def brute_manifest(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [proof_of([leaf(r) for r in by_source[s]], 0)[0] for s in order]
    out = []
    for at, s in enumerate(order):
        root, above = proof_of(subroots, at)
        for k, row in enumerate(by_source[s]):
            subroot, below = proof_of([leaf(r) for r in by_source[s]], k)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            value = leaf(row, lower=hit)
            for left, right in below + above:
                value = sha(*left, value, *right)
            proof = sha(*[x for left, right in below + above for x in left + right])
            out.append((row[0], leaf(row), subroot, root, proof, value, value == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_of(spark, rows):
    return sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [1, 2, 300, 33], [3] * 20])
def test_manifest_equals_brute_force(spark, sizes):
    words = ["Ärger", "alpha", "BETA", "", "ΣΩ", "x" * 5000, None]
    rows = []
    for s, n in enumerate(sizes):
        rows += [(1000 * s + k, [None, "é", "Z", "a"][s % 4] if s < 4 else f"s{s}", "en", k, words[k % 7]) for k in range(n)]
    random.Random(1).shuffle(rows)
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_manifest_nulls_repeats_clashes_and_empty(spark):
    rows = [(None, None, None, None, None), (5, "a", "en", 3, "ABC"), (5, "a", "en", 3, "ABC"), (5, "a", "de", 3, "abd"), (None, "a", "en", 1, "Q"), (6, "", "en", None, "")]
    assert manifest_of(spark, rows) == brute_manifest(rows)
    clash = spark.createDataFrame([r + ("x", "y", 1, 2, 3, 4) for r in rows], DOCS + ", g string, digest string, i int, chunk int, levels int, climbs int")
    assert sorted(map(tuple, merkle.manifest(clash).collect()), key=repr) == brute_manifest(rows)
    assert manifest_of(spark, []) == []


def test_manifest_of_more_than_one_round(spark):
    """A source above FAN ** (2 * LEVELS) leaves needs a third round; sources in between a second."""
    rows = [(k, "hot" if k % 3 else f"s{k % 300}", "en", k, f"T{k}") for k in range(5000)]
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_a_parent_resumes_the_state_of_a_slot():
    children = [sha(str(k)).encode() for k in range(16)]
    parent = merkle.Parent(children)
    for slot in (0, 7, 15):
        new = sha("new").encode()
        assert parent.fold(slot, new).decode() == hashlib.sha256(b"".join(children[:slot] + [new] + children[slot + 1:])).hexdigest()
        step = merkle.Step(*parent.siblings(slot))
        assert step.fold(new) == parent.fold(slot, new)


def test_registered_manifest(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert sorted(map(tuple, queries()["op12_merkle_manifest"](spark, SMALL).collect()), key=repr) == brute_manifest(given)


# Whitening.

def brute_whitening(rows, k=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    y = (far / n).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    with np.errstate(divide="ignore", invalid="ignore"):
        return (far * far).sum(axis=1), y @ vectors / np.sqrt(np.maximum(values, 0)), values / np.trace(y.T @ y / n)


def check_whitening(got, ids, rows, tolerance=1e-7):
    deviation, whitened, explained = brute_whitening(rows)
    k, at = whitened.shape[1], {i: j for j, i in enumerate(ids)}
    assert len(got) == len(rows) * k
    table = np.full(whitened.shape, np.nan)
    for r in got:
        j = at[r["vec_id"]]
        table[j, r["component"] - 1] = r["whitened"]
        assert r["n"] == len(rows) and r["deviation"] == deviation[j]
        assert abs(r["explained"] - explained[r["component"] - 1]) <= 1e-9 * explained[0]
        assert r["identity_error"] <= 1e-9
    sign = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table * sign - whitened).max() < tolerance


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


@pytest.mark.parametrize("n,d,parts", [(200, 5, 1), (500, 40, 7), (90, 33, 4)])
def test_whitening_equals_eigh(spark, n, d, parts):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, d)) * (1 + np.arange(d))).astype(np.float32)
    df = vectors_of(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]).repartition(parts)
    check_whitening(whitening.whiten(df).collect(), range(n), x)


def test_whitening_drops_only_what_has_no_numbers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    good = [(i, [float(c) for c in v], None) for i, v in enumerate(x)]
    bad = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [NAN] * 4, 1), (103, [INF, 0.0, 0.0, 0.0], 1), (104, [], 1), (105, [1.0], 1)]
    check_whitening(whitening.whiten(vectors_of(spark, good + bad)).collect(), range(60), x)
    clash = spark.createDataFrame([(i, v) + ODD for i, v, _ in good], f"vec_id long, embedding array<float>, {CLASH}")
    check_whitening(whitening.whiten(clash).collect(), range(60), x)


def test_whitening_without_variance_repeats_and_empty(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, None, 0)])).collect() == []
    one = whitening.whiten(vectors_of(spark, [(1, [0.5, 2.0], 0)])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = whitening.whiten(vectors_of(spark, [(None, [0.0, 1.0], 0), (7, [4.0, 1.0], 0), (7, [4.0, 1.0], 0)])).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["whitened"] is None) for r in line) == [("7", 1, False), ("7", 1, False), ("7", 2, True), ("7", 2, True), ("None", 1, False), ("None", 2, True)]
    assert {round(r["explained"], 12) for r in line} == {0.0, 1.0} and max(r["identity_error"] for r in line) < 1e-12


def test_whitening_keeps_exact_long_deviations_of_large_entries(spark):
    rows = [(i, [1e9 * (i % 7), float(i)], 0) for i in range(50)]
    got = whitening.whiten(vectors_of(spark, rows, "double")).collect()
    want, _, _ = brute_whitening([v for _, v, _ in rows])
    for r in got:
        assert r["deviation"] == (int(want[r["vec_id"]]) if want[r["vec_id"]] < 2 ** 63 else None)


@pytest.mark.parametrize("n,size", [(5, 9), (51_282, 60), (120_000_000, 40), (10 ** 10, 10 ** 4), (10 ** 12, 10 ** 9)])
def test_deviations_are_exact_at_every_size(n, size):
    rng = np.random.default_rng(size)
    y, whole = rng.integers(-size, size + 1, (50, 64)), np.array([int(v) for v in rng.integers(0, n, 64)], dtype=object)
    want = [sum((n * int(a) - w) ** 2 for a, w in zip(row, whole, strict=True)) for row in y]
    assert whitening.squares(n, y, whole) == [w if w < 2 ** 63 else None for w in want]


@pytest.mark.parametrize("seed", range(4))
def test_rank_one_updates_keep_the_scatter(seed):
    rng = np.random.default_rng(seed)
    d = [1, 6, 20, 33][seed]
    x = rng.integers(-40, 40, (150, d)) + 1_000_000
    if d > 4:
        x[:, 2], x[60:90], x[:, 4] = x[:, 1], x[7], 1_000_005  # deflation: equal columns, repeated rows, a constant
    alone, two = whitening.Spectrum(d), [whitening.Spectrum(d), whitening.Spectrum(d)]
    for k in range(0, 150, 1 + seed):
        alone.add(x[k:k + 1 + seed])
        two[k > 70].add(x[k:k + 1 + seed])
    two[0].merge(whitening.Spectrum.unpack(two[1].pack()))
    y = x - x.mean(axis=0)
    for s in (alone, two[0]):
        assert s.n == 150 and list(s.sums) == list(x.sum(axis=0))
        assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - y.T @ y).max() < 1e-10 * max(1.0, np.abs(y.T @ y).max())
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12


def test_registered_whitening(spark):
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check_whitening(queries()["op11_whitening"](spark, SMALL).collect(), [r["vec_id"] for r in given], [r["embedding"] for r in given])


# Top-k search.

def brute_top(rows, k=10, every=100):
    good = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i is None or i % every:
            continue
        found = [(-sum(p * q for p, q in zip(v, w, strict=True)), j is None, j or 0) for b, (j, w) in enumerate(good) if a != b and len(w) == len(v)]
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def top(spark, rows, **given):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted(map(tuple, topk.search(df, **given).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_top_k_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(700, [3, 16, 24][seed])).astype(np.float32)
    x[200:400] = x[5]  # a hot group: equal scores over many blocks
    x[500:520] = 0
    if seed == 2:
        x = np.abs(x)
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(700), x, strict=True)]
    assert top(spark, rows, block=64, first=64, growth=3, slice_size=4, blocks=2) == brute_top(rows)
    assert top(spark, rows) == brute_top(rows)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [NAN, 1.0]), (300, [1.0, None]), (400, [INF, 0.0]), (500, []), (600, [1.0]), (None, [3.0, 3.0]), (0, [1.0, 2.0]), (7, [-1.0, 0.0]), (700, [0.0, 0.0])]
    assert top(spark, rows) == brute_top(rows)
    assert top(spark, []) == [] and top(spark, [(100, [1.0])]) == [] and top(spark, [(1, [1.0]), (2, [1.0])]) == []
    clash = spark.createDataFrame([(i, v) + ODD for i, v in rows], f"vec_id long, embedding array<float>, {CLASH}")
    assert sorted(map(tuple, topk.search(clash).collect()), key=repr) == brute_top(rows)


def test_registered_top_k(spark):
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries()["op13_top_k"](spark, SMALL).collect()), key=repr) == brute_top(given)


# Repairs of secrets and extraction.

def test_a_ledger_starts_in_a_new_folder_and_counts_present_versions_only(spark, tmp_path):
    from dataclasses import replace

    from sparkwitness.llm import secrets

    folder = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token = abcdefghijkl0"), (2, None), (3, "token = abcdefghijkl0"), (3, "x")], "doc_id long, text string")
    old = tuple(replace(r, version=0) for r in secrets.RULES)
    first = secrets.digest(docs, folder=folder, rules=old).collect()
    again = secrets.digest(docs, folder=folder).collect()
    fresh = secrets.digest(docs).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) == sorted(map(tuple, fresh))
    assert {r.doc_id: (r.n_assign, r.spans) for r in again if r.doc_id < 3} == {1: (1, "assign:0:21"), 2: (0, "")}
    ledger = secrets.Ledger(spark, folder)
    assert ledger.findings().count() == 2 and ledger.current().count() == 1  # one blob, two versions


@pytest.mark.parametrize("html,text", [
    ("<nav>menu</nav><article><h1>Short</h1><ul><li>one item</li></ul></article>", "Short\n\none item"),
    ("<article><div>Short text here.</div><div>Another.</div></article><footer>f</footer>", "Short text here.\n\nAnother."),
    ("<main>a &amp; b</main>", "a & b"), ("<div>no article</div>", ""),
    ("<article><p>One.</p><figure><img src=x><figcaption>Caption.</figcaption></figure><p>E <math><mi>m</mi></math></p></article>", "One.\n\nCaption.\n\nE m"),
    ("<article><section id=discussion><h2 id=search>On search</h2><p>Text.</p></section><p class=byline>By A</p><div class='ad'>buy</div><div id=comments>me too</div></article>",
     "On search\n\nText.\n\nBy A"),
    ("<div id=search>find</div><article><p>Only this.</p></article>", "Only this."),
])
def test_extraction_keeps_what_an_article_holds(html, text):
    from sparkwitness.llm import extract

    assert extract.main_text(html) == text


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "x", "<b>" * 15_000 + "y" + "</i>" * 15_000, "<i><div>" * 8_000 + "</i></b>" * 8_000, "<p><b>" * 15_000])
def test_deep_pages_take_linear_time(html):
    import time

    from sparkwitness.llm import extract

    start = time.perf_counter()
    extract.main_text(html)
    assert time.perf_counter() - start < 3


def test_extraction_of_odd_rows(spark):
    from sparkwitness.llm import extract

    page = "<article><p>Text.</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "x" * 300_000)]
    df = spark.createDataFrame([r + (9, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = sorted(((r.page_id, r.text[:5], r.n_chars) for r in extract.extract(df).collect()), key=repr)
    assert got == sorted([(1, "Text.", 5), (1, "Text.", 5), (None, "", 0), (2, "", 0), (3, "xxxxx", 300_000)], key=repr)


# Odd rows of the earlier operators: clashing columns, repeated rows, null ids, null and very long texts.

LONG = "word " * 60_000
ODD_DOCS = [(1, "plain words here"), (1, "plain words here"), (None, "plain words here"), (2, None), (3, ""), (4, LONG), (5, "you are a total idiot"), (5, "other text")]
DOC_COLUMNS = "doc_id long, text string, label int, score double, held_out int, predicted string, source string, lang string, n_chars long, n int, place int, item_id int, words int"
DOC_REST = (1, 0.5, 2, "p", None, "en", 3, 4, 5, 6, 7)


def odd_documents(spark):
    return spark.createDataFrame([r + DOC_REST for r in ODD_DOCS], DOC_COLUMNS)


@pytest.mark.parametrize("name,label", [("quality", "quality"), ("toxicity", "toxic")])
def test_classifiers_score_every_odd_row(spark, name, label):
    import importlib

    module = importlib.import_module(f"sparkwitness.llm.{name}")
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (5, 0, 1), (None, 1, 1), (2, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.classify(docs, module.train(docs, labels, label)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ODD_DOCS)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    same = {r.score for r in got if r.doc_id in (None, 1)}  # equal texts score alike, whatever their id
    assert len(same) == 1


def test_decontamination_of_odd_rows(spark):
    from sparkwitness.llm import decontaminate

    item = " ".join(f"item{k}" for k in range(12))
    held = "before " * 50_000 + item + " after"
    rows = ODD_DOCS + [(7, held), (7, held), (None, held), (8, item.replace("item3", "other"))]
    docs = spark.createDataFrame([r + DOC_REST for r in rows], DOC_COLUMNS)
    items = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, item, "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    found = decontaminate.find(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.edits) for r in found) == [("7", 1, 0), ("7", 1, 0), ("8", 1, 1), ("None", 1, 0)]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, docs.select("doc_id", "text").limit(len(ODD_DOCS)).collect()))


def edits(item, text):
    """Least edits of the item to any stretch of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for a, x in enumerate(item, 1):
        last, row[0] = row[0], a
        for b, y in enumerate(text, 1):
            last, row[b] = row[b], min(row[b] + 1, row[b - 1] + 1, last + (x != y))
    return min(row)


def test_decontamination_against_an_exact_scan_of_edit_distances(spark):
    """Substitutions, insertions, deletions and all of them: no clean document is named, nearly every held item is."""
    from sparkwitness.llm import decontaminate

    choice = random.Random(3)
    vocabulary = [f"w{k}" for k in range(900)]
    items = [[choice.choice(vocabulary) for _ in range(choice.randint(12, 30))] for _ in range(12)]
    docs = []
    for n in range(160):
        words = [choice.choice(vocabulary) for _ in range(choice.randint(0, 60))]
        if n % 4:
            part = list(choice.choice(items))
            for _ in range(int(0.15 * len(part))):
                at, kind = choice.randrange(len(part)), (choice.randrange(3) if n % 4 == 3 else n % 4 - 1)
                part[at:at + (kind != 1)] = [] if kind == 2 else ["edited"]
            words[len(words) // 2:len(words) // 2] = part
        docs.append((n, " ".join(words)))
    wanted = {(n, i) for n, t in docs for i, item in enumerate(items) if edits(item, t.split()) <= int(decontaminate.SHARE * len(item))}
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    named = {(r.doc_id, r.item_id) for r in found.collect()}
    assert named <= wanted and len(wanted) > 100
    assert len(named) >= 0.95 * len(wanted), (len(named), len(wanted))


def test_url_filter_of_odd_rows(spark):
    from sparkwitness.llm import urls

    rows = [(1, "http://a.net/es/x"), (1, "http://a.net/es/x"), (None, "http://WWW.example.com/en/?q"), (2, None), (3, ""), (4, "no scheme"), (5, "http://a.net/" + "s/" * 20_000), (6, "://b.com#f")]
    df = spark.createDataFrame([r + ("h", "p", "r", "v", 1, "t", 2) for r in rows], "page_id long, url string, host string, path string, rule string, verdict string, n int, template string, shape int")
    got = sorted(((r.page_id, r.host, r.path[:8], r.rule, r.verdict) for r in urls.judge(df).collect()), key=repr)
    assert got == sorted([
        (1, "a.net", "/es/x", "net/es/", "block"), (1, "a.net", "/es/x", "net/es/", "block"), (None, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "a.net", "/s/s/s/s", None, "allow"), (6, "b.com", "", None, "allow"),
    ], key=repr)


def test_near_duplicates_of_odd_rows(spark):
    from sparkwitness.llm import covertree

    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (4, None, 1), (5, [NAN, 1.0], 1), (6, [0.0, 0.0], 1), (7, [2.0, 0.1], 1), (8, [0.0, 1.0], 1)]
    df = spark.createDataFrame([r + (1, 2, 3, 4, 5.0) for r in rows], "vec_id long, embedding array<float>, label int, id int, v int, g int, w int, component double")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(df).collect()), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (7, 3, 1, False), (3, 0, 3, True), (None, 0, None, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (8, 0, 8, True)]
    assert got == sorted(want, key=repr)
