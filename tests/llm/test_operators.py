"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from conftest import DATA, rows_of, rows_of_sql

from aliasmith.llm import bpe, decontaminate, html_extract, neardup, quality, queries, substring, token_counts, toxicity, url_rules

DOCS = "doc_id long, text string, _gone string, bucket int, spots string"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def words(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def docs_of(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def edge(spark):
    return docs_of(spark, [(None, "some words here"), (1, None), (2, ""), (3, "  .. "), (4, "one"), (4, "one"), (5, "word " * 60_000), (6, "Ünïcode — ñandú's 日本語 42\r\n\t x")])


def empty(spark):
    return docs_of(spark, []).limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == rows_of_sql(duck, queries.ORACLE_SQL[name])


def encoding(path):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_tokenizer_and_round_trips(spark):
    e = encoding(bpe.VOCABULARY)
    rows = [r for r in edge(spark).collect() if r.doc_id != 5] + [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    d = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "doc_id long, text string")
    out = bpe.encode(d)
    got = {r.doc_id: r for r in out.collect()}
    for i, r in enumerate(rows):
        if r.text is None:
            assert got[i].ids is None and got[i].n_tokens is None
        else:
            assert got[i].ids == e.encode_ordinary(r.text) and got[i].round_trip and got[i].n_tokens == len(got[i].ids)
    back = {r.doc_id: r.text for r in bpe.decode(out).collect()}
    assert back == {i: r.text for i, r in enumerate(rows)}
    assert bpe.encode(empty(spark)).count() == 0


def test_bpe_long_piece():
    v = bpe.vocabulary()
    text = ("ab" * 700 + "!" * 900).encode()
    ids, bounds = v.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == encoding(bpe.VOCABULARY).encode_ordinary(text.decode())


def test_token_counts_are_the_tokenizers(spark):
    e = encoding(token_counts.VOCABULARY)
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")).repartition(3)
    want = {r.doc_id: len(e.encode_ordinary(r.text or "")) for r in d.collect()}
    for block in (64, 1 << 20):
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark, d, block_bytes=block).collect()} == want
    assert token_counts.token_counts(spark, empty(spark)).count() == 0


def test_token_files_with_any_blocks(spark, tmp_path):
    r = random.Random(1)
    files, want = [], {}
    for k in range(6):
        lens = [r.choice([0, 1, 2, 5, 90]) for _ in range(r.randint(0, 12))]
        ids = [x for n in lens for x in [7] * n + [9]] + [7] * (k % 3) * 40
        path = f"{tmp_path}/{k}.tok"
        np.array(ids, "<u2").tofile(path)
        files.append((path,))
        want.update({(path, i, True): n for i, n in enumerate(lens)})
        if k % 3:
            want[path, len(lens), False] = k % 3 * 40
    f = spark.createDataFrame(files, "file string")
    for block in (2, 6, 64, 4096):
        assert {(x.file, x.ordinal, x.ended): x.n_tokens for x in token_counts.count_files(f, 9, block_bytes=block).collect()} == want


def jaccard(a, b):
    x, y = (set(zip(*[t.lower().split()[k:] for k in range(3)])) or {tuple(t.lower().split())} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(2)
    rows = []
    for g in range(40):
        w = words(r, r.randint(30, 300)).split()
        for _ in range(r.choice([1, 1, 2, 4, 12])):
            v = w[:]
            for _ in range(len(v) // 40):
                v[r.randrange(len(v))] = words(r, 1)
            rows.append((len(rows), " ".join(v)))
    rows += [(len(rows) + i, w) for i, w in enumerate(["two words", "two words", "Two Words", "other words"])]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = [(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.6]
    for a, b in near:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.doc_id: x.kept_id for x in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    found = sum(got.get(a, a) == got.get(b, b) for a, b in near)
    assert found >= 0.97 * len(near)
    text = dict(rows)
    assert all(find(a) == find(b) or jaccard(text[a], text[b]) > 0.3 for a, b in got.items())
    kept = neardup.drop_near_duplicates(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns and kept.count() == len(rows) - len(got)


def test_near_duplicate_edges(spark):
    got = sorted((x.doc_id, x.text is None) for x in neardup.drop_near_duplicates(edge(spark)).collect() if x.doc_id is not None)
    assert got == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, False)]
    assert neardup.drop_near_duplicates(edge(spark)).filter("doc_id is null").count() == 1
    assert neardup.drop_near_duplicates(empty(spark)).count() == 0


def test_centres_in_a_crowded_bucket():
    r = np.random.default_rng(1)
    least = [np.sort(x).tobytes() for x in r.choice(1 << 31, (100, neardup.SKETCH), replace=False).astype(np.uint32)] * 2
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 200), pa.array([0] * 200), pa.array(np.arange(200)), pa.array(least)], ["bucket", "part", "doc_id", "sketch"])
    for k in (1, 7, 200):
        out = [x for b in neardup._centres(0.45)(iter([batch.slice(i, k) for i in range(0, 200, k)])) for x in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
        assert sorted(out) == sorted([(i, i + 100) for i in range(100)] + [(i, i) for i in range(100)])


def test_similarity_is_exact_for_short_texts_and_close_for_long_ones():
    r = np.random.default_rng(2)
    for n, error in ((5, 1e-12), (150, 1e-12), (20_000, 0.12)):
        for share in (0.0, 0.3, 0.7, 1.0):
            x = r.choice(1 << 62, 2 * n, replace=False).astype(np.uint64)
            a, b = x[:n], np.r_[x[: int(share * n)], x[n : 2 * n - int(share * n)]]
            s, at = np.r_[a, b], np.repeat([0, 1], [len(a), len(b)])
            p, q = (neardup._matrix([y]) for y in neardup.sketches(s, at, 2))
            assert abs(neardup.similar(p, q)[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) <= error


@pytest.mark.parametrize("split", [3, 4096])
def test_bucket_with_many_unlike_documents(spark, monkeypatch, split):
    # all share one passage, so many share buckets, and only copies are alike
    monkeypatch.setattr(neardup, "SPLIT", split)
    r = random.Random(3)
    common = words(r, 40)
    texts = [f"{common} {words(r, 60)}" for _ in range(60)]
    rows = [(i + 60 * k, t) for k in (0, 1, 2) for i, t in enumerate(texts)]
    rows = [(i, t + (f" {words(r, 2)}" if i >= 60 else "")) for i, t in rows]
    got = {x.doc_id: x.kept_id for x in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: i % 60 for i in range(60, 180)}


def test_components_of_chains_and_rings(spark):
    chain, ring = [(i, i + 1) for i in range(40)], [(100 + i, 100 + (i + 7) % 30) for i in range(30)]
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in chain + ring], "a long, b long")
    assert {x.node: x.root for x in neardup.components(edges).collect()} == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


def test_near_duplicate_rows_of_one_doc_id(spark):
    r = random.Random(4)
    a, b, c = (words(r, 80) for _ in range(3))
    rows = [(1, a), (2, a + " end"), (2, b), (3, b), (3, c), (3, c), (4, ".."), (4, ".."), (5, None), (5, None)]
    kept = sorted((x.doc_id, x.text or "") for x in neardup.drop_near_duplicates(docs_of(spark, rows)).collect())
    assert kept == sorted([(1, a), (2, b), (3, c), (4, ".."), (4, ".."), (5, ""), (5, "")])
    assert sorted((x.doc_id, x.kept_id) for x in neardup.near_duplicates(docs_of(spark, rows)).collect()) == [(2, 1), (3, 2)]


def brute_windows(rows, length):
    at = {}
    for i, t in rows:
        w = t.lower().split()
        for p in range(len(w) - length + 1):
            at.setdefault(tuple(w[p : p + length]), []).append((i, p))
    return {x: x == min(v) for v in at.values() if len(v) > 1 for x in v}


def test_substrings_against_all_windows(spark):
    r = random.Random(3)
    shared = [words(r, n) for n in (50, 55, 60, 80, 150, 400)]
    rows = []
    for i in range(60):
        parts = [words(r, r.randint(0, 120)) for _ in range(4)]
        for s in r.sample(shared, 2):
            parts.insert(r.randint(0, 4), s)
        if i % 10 == 0:
            parts.append("again and " * 60)
        rows.append((i, " ".join(p for p in parts if p)))
    got = {(x.doc_id, x.pos): x.first for x in substring.repeated_windows(docs_of(spark, rows)).collect()}
    want = brute_windows(rows, substring.LENGTH)
    assert got == want
    kept = {x.doc_id: x.text for x in substring.drop_shared_passages(docs_of(spark, rows)).collect()}
    left = brute_windows(list(kept.items()), substring.LENGTH)
    assert len(left) < 0.02 * len(want) and kept[0].startswith(rows[0][1][:20])


def test_substring_edges(spark):
    out = substring.drop_shared_passages(edge(spark))
    got = {(x.doc_id, x.text) for x in out.collect()}
    assert {(1, None), (2, ""), (3, "  .. "), (None, "some words here")} <= got and out.columns == edge(spark).columns
    assert substring.drop_shared_passages(empty(spark)).count() == 0
    assert substring.shared_passages(empty(spark)).count() == 0
    grown = docs_of(spark, [(i, "ẞİK " + "stadt straße " * 30 + t) for i, t in enumerate(["end", "other"])])
    assert {x.text.strip().split()[0] for x in substring.drop_shared_passages(grown).collect() if x.doc_id == 0} == {"ẞİK"}


def test_leaks_against_all_windows(spark):
    r = random.Random(4)
    items = [(i, words(r, r.randint(8, 60))) for i in range(12)] + [(90, None), (91, ""), (92, "two words")]
    rows = []
    for i in range(60):
        body = words(r, r.randint(5, 200)).split()
        if i % 3 == 0:
            w = items[i % 12][1].split()
            for _ in range(i % 4):
                w[r.randrange(len(w))] = words(r, 1)
            at = r.randint(0, len(body))
            body[at:at] = w
        rows.append((i, " ".join(body)))
    rows.append((60, "here are two words to find"))

    def weighted(w):
        n = min(3, len(w))
        return [(tuple(w[k : k + n]), sum(len(x) for x in w[k : k + n])) for k in range(len(w) - n + 1)]

    def similarity(a, b):
        from collections import Counter

        x, y = Counter(s for s, _ in weighted(a)), Counter(s for s, _ in weighted(b))
        weigh = dict(weighted(a) + weighted(b))
        both = sum(min(x[s], y[s]) * weigh[s] for s in x)
        return both / (sum(c * weigh[s] for s, c in x.items()) + sum(c * weigh[s] for s, c in y.items()) - both)

    want = {}
    for d, t in rows:
        w = t.split()
        for i, x in items:
            v = (x or "").split()
            sims = [(similarity(w[p : p + len(v)], v), -p) for p in range(len(w) - len(v) + 1)] if v else []
            if sims and max(sims)[0] >= decontaminate.SIMILARITY:
                want[d, i] = max(sims)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.similarity, -x.start_word) for x in decontaminate.leaks(docs_of(spark, rows), b).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 15
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in got)
    kept = {x.doc_id for x in decontaminate.drop_leaks(docs_of(spark, rows), b).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(edge(spark), nothing).count() == 0 and decontaminate.drop_leaks(edge(spark), b).count() == 8
    assert decontaminate.leaks(empty(spark), b).count() == 0


def test_multi_index_finds_all_within_the_radius():
    r = np.random.default_rng(5)
    items = decontaminate.Items(list(range(30)), [words(random.Random(i), 12) for i in range(30)])
    prints, length, want = [], [], set()
    for k in range(400):
        i = k % 30
        flips = r.choice(64, r.integers(0, decontaminate.RADIUS + 4), replace=False)
        p = items.prints[i] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
        prints.append(p)
        length.append(12)
        want |= {(k, j) for j in range(30) if bin(int(p ^ items.prints[j])).count("1") <= decontaminate.RADIUS}
    a, b = items.near(np.array(prints, np.uint64), np.array(length))
    assert set(zip(a.tolist(), b.tolist())) == want


def test_html_labels_and_held_out_accuracy():
    field = html_extract.train()
    test = html_extract.labelled_pages(80, seed=77)
    features = [html_extract.blocks(p)[1] for p, _ in test]
    right = [a == b for x, (_, y) in zip(field.decode(features), test) for a, b in zip(x, y)]
    assert np.mean(right) > 0.98
    pages = pq.read_table(f"{DATA}/pages.parquet")["html"].to_pylist()
    found = [html_extract.blocks(p) for p in pages]
    same = 0
    for p, (texts, _), y in zip(pages, found, field.decode([f for _, f in found])):
        truth = html_extract.blocks(p[p.index("<article>") : p.index("</article>")])[0]
        same += [t for t, k in zip(texts, y) if k] == truth
    assert same >= 0.95 * len(pages)


def test_viterbi_against_all_labellings():
    import itertools

    r = np.random.default_rng(6)
    n = len(html_extract._FEATURES)
    f = html_extract.Field(r.normal(size=(n, 2)), r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=2))
    pages = [[[int(x) for x in r.integers(0, n, 4)] for _ in range(k)] for k in (1, 2, 5, 7, 0, 3)]
    for page, y in zip(pages, f.decode(pages)):
        if not page:
            assert len(y) == 0
            continue
        e = np.array([f.weights[b].sum(0) for b in page])

        def score(v, e=e):
            return f.begin[v[0]] + f.end[v[-1]] + sum(e[i, k] for i, k in enumerate(v)) + sum(f.step[a, b] for a, b in itertools.pairwise(v))

        assert list(y) == list(max(itertools.product((0, 1), repeat=len(page)), key=score))


def test_html_edges(spark):
    rows = [(1, None), (2, ""), (3, "plain text only"), (4, "<p>unclosed <b>bold<script>var x = '</p>'"), (4, "<div><!-- never ends"), (None, "<article><p>Some longer text, in a paragraph. It ends.</p></article>"), (5, "<p>x</p>" * 5000), (6, "</div></p><li>a<li>b&amp;c &#233;")]
    p = spark.createDataFrame([(i, h, "t") for i, h in rows], "page_id long, html string, text string")
    got = html_extract.extract(p).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id == 1] == [None] and [r.text for r in got if r.page_id == 2] == [""]
    assert html_extract.blocks("</div></p><li>a<li>b&amp;c &#233;")[0] == ["a", "b&c é"]
    assert html_extract.extract(p.limit(0)).count() == 0


def test_url_verdicts_against_every_rule(spark):
    r = random.Random(8)
    labels, tlds = ["a", "b", "www", "blog"], ["x.com", "y.org", "co.uk"]
    url = lambda: f"http://{'.'.join(r.choices(labels, k=r.randint(0, 2)) + [r.choice(tlds)])}/{r.choice(['', 'p', 'p/q', 'p/qr', '?z=1'])}"
    urls = [(i, url()) for i in range(300)] + [(300, None), (301, ""), (302, "HTTPS://User@A.X.com:80?q#f"), (303, "http://10.2.3.4/z"), (304, urls_first := "http://a.x.com/p"), (304, urls_first)]
    rules = [("x.com", "block"), ("a.x.com", "allow"), ("a.x.com/p", "block"), ("a.x.com/p/q", "allow"), ("y.org/p", "block"), ("uk", "block"), ("uk", "allow"), ("10.2.3.4", "block"), (None, "block"), ("", "block"), ("b.x.com", "other")]
    pages = spark.createDataFrame([(i, u, "k") for i, u in urls], "page_id long, url string, key string")
    table = spark.createDataFrame(rules, "rule string, action string")
    from pyspark.sql import functions as F

    keys = {x.rule: x.k for x in table.select("rule", url_rules.rule_key(F.col("rule")).alias("k")).collect() if x.k}
    order = {"block": 0, "allow": 1}
    own = {}
    for rule, action in rules:
        if rule in keys and action in order and (keys[rule] not in own or order[action] < order[own[keys[rule]][1]]):
            own[keys[rule]] = (rule, action)
    for ranges in (1, 3, 40):
        got = url_rules.verdicts(pages, table, ranges).collect()
        assert len(got) == len(urls)
        for x in got:
            hit = [k for k in own if x.url_key is not None and x.url_key.startswith(k)]
            assert x.n_rules == len(hit) and (x.rule, x.action) == (own[max(hit, key=len)] if hit else (None, None)) and x.keep == (x.action != "block")
    key = {x.page_id: x.url_key for x in got}
    assert key[302] == "com.x.a./?q" and key[303] == "10.2.3.4./z" and key[300] is None
    assert url_rules.verdicts(pages.limit(0), table).count() == 0 and url_rules.verdicts(pages, table.limit(0)).filter("keep").count() == len(urls)


def brute_repeats(w, least=5):
    longest, cover = 0, set()
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                cover.update(range(i, i + k), range(j, j + k))
    return len(cover), longest


def test_quality_against_all_pairs(spark):
    r = random.Random(9)
    rows = []
    for i in range(80):
        w = [r.choice("ab" if i % 4 == 0 else "abcdefgh") for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            w = w + w[: r.randint(0, 40)]
        rows.append((i, " ".join(w)))
    for x in quality.repetition_rules(docs_of(spark, rows)).collect():
        w = rows[x.doc_id][1].split()
        assert (x.n_words, x.covered_words, x.longest_repeat) == (len(w), *brute_repeats(w))
    e = {(x.doc_id, x.n_words): x for x in quality.repetition_rules(edge(spark)).collect()}
    assert e[1, 0].keep and e[2, 0].keep and not e[5, 60_000].keep and e[5, 60_000].longest_repeat == 59_999
    assert quality.repetition_rules(empty(spark)).count() == 0


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(10)
    bad, good = [words(r, 1) for _ in range(12)], [words(r, 1) for _ in range(300)]
    rows = [(i, " ".join(r.choices(good, k=60) + (r.choices(bad, k=12) if i % 4 == 0 else []))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.score(docs_of(spark, rows), toxicity.train(docs_of(spark, rows), labels)).collect()}
    right = [out[i].toxic == (i % 4 == 0) for i in range(300, 600)]
    assert np.mean(right) > 0.97
    assert {x.doc_id for x in toxicity.drop_toxic(docs_of(spark, rows), labels).collect()} == {i for i, x in out.items() if not x.toxic}
    kept = toxicity.drop_toxic(edge(spark), labels)
    assert kept.count() == 8 and kept.columns == edge(spark).columns
    assert toxicity.drop_toxic(empty(spark), labels.limit(0)).count() == 0
