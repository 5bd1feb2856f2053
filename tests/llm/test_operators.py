"""Each operator against a brute-force version, and on odd input."""
import base64
import hashlib
import itertools
import random
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from spoor.llm import ann, bpe, decontam, extract, graph, langid, packing, quality, shard, simhash, warc
from spoor.llm.common import run_path

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


# --- sharding -------------------------------------------------------------------

def test_shards_are_even_and_keep_copies_together(docs_of):
    rng = random.Random(1)
    texts = [_words(rng, rng.randint(5, 60)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:40] + [texts[0]] * 20)]
    found = shard.shard_documents(docs_of(rows), 8).collect()
    sizes, shards = {}, {}
    for r in found:
        assert r["size"] == len(rows[r.doc_id][1].encode()) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode())
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        shards.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert len(found) == len(rows) and set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in found)
    assert all(len(s) == 1 for s in shards.values())
    for s in range(8):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_a_group_larger_than_a_shard_is_split(docs_of):
    rng = random.Random(2)
    rows = [(i, "same text " * 5 if i % 3 == 0 else _words(rng, 9)) for i in range(400)]
    sizes = {}
    for r in shard.shard_documents(docs_of(rows), 8).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 120


def _homes(spark, keys, n):
    rows = spark.createDataFrame([(k,) for k in keys], "key long")
    return {r.key: r.home for r in rows.select("key", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(n)).alias("home")).collect()}


def test_wishes_match_counting_by_hand(spark):
    rng, n = random.Random(3), 4
    label = {v: rng.randrange(n) for v in range(120)}
    links = {(rng.randrange(120), rng.randrange(30)) for _ in range(400)}
    home = _homes(spark, range(30), n)
    want = {}
    for v, here in label.items():
        votes = [0.0] * n
        for _, key in (own := [link for link in links if link[0] == v]):
            votes[home[key]] += 0.5
            for u, other in links:
                votes[label[u]] += other == key
        target = max(range(n), key=lambda j: (votes[j], -j))
        if own and target != here:
            want[v] = (target, votes[target] - votes[here])
    labels = spark.createDataFrame([(v, 1, s) for v, s in label.items()], "v long, size long, shard int")
    rows = shard._wishes(labels, spark.createDataFrame(sorted(links), "v long, key long"), n).collect()
    assert {r.v: (r.target, r.gain) for r in rows} == want and len(rows) == len(want) > 20


def _cut(links, label):
    """Pairs of vertices that share a key and lie in different shards."""
    by_key = {}
    for v, key in links:
        by_key.setdefault(key, []).append(v)
    return sum(label[a] != label[b] for vs in by_key.values() for a, b in itertools.combinations(sorted(vs), 2))


def test_cut_is_no_worse_than_that_of_moves_one_at_a_time(spark):
    rng, n = random.Random(5), 4
    sizes = {v: rng.randint(1, 9) for v in range(400)}
    links = {(v, v // 10) for v in range(300)} | {(rng.randrange(300), 100 + k) for k in range(20) for _ in range(2)}
    neighbours = {v: [u for own, key in links if own == v for u, other in links if other == key and u != v] for v in sizes}
    start = {r.v: r.s for r in spark.range(400).select(F.col("id").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("s")).collect()}
    plain, room = dict(start), sum(sizes.values()) / n + max(sizes.values())
    for _ in range(6):                          # a vertex at a time goes where most neighbours are, if there is room
        for v in range(300):
            full = [sum(sizes[u] for u in sizes if plain[u] == j) for j in range(n)]
            votes = [sum(plain[u] == j for u in neighbours[v]) for j in range(n)]
            best = max((j for j in range(n) if j == plain[v] or full[j] + sizes[v] <= room), key=lambda j: (votes[j], j == plain[v]))
            plain[v] = best
    vertices = spark.createDataFrame(list(sizes.items()), "v long, size long")
    found = {r.v: r.shard for r in shard.balanced_shards(vertices, spark.createDataFrame(sorted(links), "v long, key long"), n).collect()}
    held = [sum(sizes[v] for v in sizes if found[v] == j) for j in range(n)]
    print("cut: start, one at a time, found", _cut(links, start), _cut(links, plain), _cut(links, found), held)
    assert set(found) == set(sizes) and max(held) - min(held) <= 2 * max(sizes.values())
    assert _cut(links, found) <= _cut(links, plain) < _cut(links, start)


def test_shards_of_odd_rows(odd, docs_of):
    found = shard.shard_documents(odd, 8).collect()
    assert len(found) == odd.count() and {r["size"] for r in found if r.doc_id == 1} == {1}
    assert shard.shard_documents(docs_of([]), 8).count() == 0


# --- near duplicates --------------------------------------------------------------

def _slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _slow_components(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash_matches_brute_force(docs_of):
    rng = random.Random(3)
    base = [_words(rng, 150) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 160):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words).upper() if i % 2 else "\t".join(words)))
    fps = {i: _slow_fingerprint(t) for i, t in rows}
    want = _slow_components(fps)
    found = simhash.near_duplicates(docs_of(rows)).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in found} == want
    kept = simhash.keep_one(docs_of(rows))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and "_size" in kept.columns


@pytest.mark.parametrize("crowd", [1, 10_000])
def test_links_do_not_depend_on_the_size_of_cells(spark, monkeypatch, crowd):
    rng = random.Random(4)
    fps = {0}
    while len(fps) < 150:      # a ball of close fingerprints: one crowded cell
        f = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 3)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = {f - (1 << 64) if f >> 63 else f for f in fps}
    monkeypatch.setattr(simhash, "CELL_PAIRS", crowd)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = {r.node: r.root for r in graph.components(links).collect()}
    want = _slow_components(fps_map := {f: f & (1 << 64) - 1 for f in fps})
    assert len(fps_map) == len(fps)
    assert {f: roots.get(f, f) for f in fps} == want


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(5)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    pairs += [(a, a ^ 1 << rng.randrange(63)) for a, _ in pairs]
    df = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", F.bit_count(simhash.embed(F.col("a")).bitwiseXOR(simhash.embed(F.col("b")))).alias("d"))
    for r in df.collect():
        cut = [(r.a >> 2 * i & 3, r.b >> 2 * i & 3) for i in range(32)]
        assert r.d == sum(abs(bin(x).count("1") - bin(y).count("1")) for x, y in cut) <= bin(r.a ^ r.b).count("1")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_simhash_of_odd_rows(odd, docs_of):
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(found) == odd.count()
    assert {(d, c) for d, _, c in found if d in (1, 2, 3)} == {(1, 1), (2, 1), (3, 1)}
    assert {c for d, _, c in found if d in (4, 5)} == {4} and (None, None) in {(d, c) for d, _, c in found}
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 6, 7, 8, 9, None], key=str)
    assert simhash.near_duplicates(docs_of([])).count() == 0


# --- neighbours ---------------------------------------------------------------------

def _vectors(n, dims=16, seed=6):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dims)))]


def test_neighbours_recall_ties_and_scores(spark):
    rows = _vectors(1500)
    rows += [(2000 + i, rows[7][1]) for i in range(500)]            # a very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 50 = 0 or vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = {}
    for r in ann.nearest(df, asked, 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array([v for _, v in rows])
    ids, unit = np.array([i for i, _ in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, got in found.items():
        scores = unit @ unit[np.flatnonzero(ids == q)[0]]
        scores[ids == q] = -9
        best = [int(ids[i]) for i in np.lexsort((ids, -np.round(scores, 12)))[:5]]
        hits, total = hits + len(set(best) & {v for _, v, _ in got}), total + 5
        assert [k for k, _, _ in sorted(got)] == [1, 2, 3, 4, 5]
        assert all(abs(s - scores[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in got)
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(found[7])] == [2000, 2001, 2002, 2003, 2004]


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert [(r.query_id, r.vec_id) for r in ann.nearest(df, asked, 5).orderBy("query_id").collect()] == [(0, 1), (1, 0)]
    assert ann.nearest(df.limit(0), asked.limit(0)).count() == 0


def test_queries_meet_all_rows_of_their_own_length(spark):
    rows = _vectors(60, 4) + [(100, [1.0] * 5), (101, [1.0, 0.5]), (102, [1.0, 0.4]), (7, [1.0, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id in (7, 9, 100, 101)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = {}
    for r in ann.nearest(df, asked.filter("query_id <> 7"), 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found[101] == [102, 7] and len(found[9]) == 5 and max(found[9]) < 60 and set(found) == {9, 101}


def test_probes_come_in_the_order_of_success():
    hasher = ann.Hasher(8, 4)
    at = hasher.project(np.ones((1, 8)) / np.sqrt(8), 0)[0]
    cells = hasher.probes(at, 0.5)
    edge = lambda c, x: ann._normal((np.array([c, c + 1]) * ann.WIDTH - x) / 0.5)
    chance = [np.prod([np.diff(edge(c, x))[0] for c, x in zip(row, at)]) for row in cells]
    assert chance == sorted(chance, reverse=True) and sum(chance) >= 1 - (1 - ann.SUCCESS) ** 0.5 - 1e-6
    assert (cells[0] == np.floor(at / ann.WIDTH)).all() or chance[0] >= chance[1]


# --- quality and language ----------------------------------------------------------

def test_factorisation_identity():
    rng = np.random.default_rng(7)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.DIMS), rng.normal(size=(quality.DIMS, quality.FACTORS)))
    at, x = quality.features("a few Words, and 3 more words.\nA line | x")
    slow = 0.3 + m.weights[at] @ x + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j]
                                         for i, j in itertools.combinations(range(len(at)), 2))
    assert abs(m.margin(at, x) - slow) < 1e-9


def test_quality_learns_and_takes_odd_rows(spark, docs_of, odd):
    rng = random.Random(8)
    rows = [(i, (_words(rng, 30) + ". ") * 2 if i % 2 else " ".join(w + "###" for w in _words(rng, 30).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, None) for i, _ in rows] + [(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs_of(rows[:200]), labels)
    found = quality.score_quality(docs_of(rows[200:]), model).collect()
    assert np.mean([(r.quality_score >= 0.5) == bool(r.doc_id % 2) for r in found]) > 0.95
    scores = [r.quality_score for r in quality.score_quality(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    flat = quality.fit_quality(docs_of([]), labels.limit(0))
    assert quality.score_quality(odd, flat).count() == odd.count()


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit_languages(docs.filter("doc_id % 3 <> 1"))
    found = langid.predict_languages(docs.filter("doc_id % 3 = 1"), model).select("lang", "prediction.*").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert max(model.langs.count(x) for x in set(model.langs)) > 1


def test_language_scores_are_cosines_of_tf_idf(docs_of):
    """Frequencies, weights and cosines again, one text at a time."""
    rng = random.Random(12)
    sets = {"xx": "abcd", "yy": "efgh"}
    train = [(i, _words(rng, 12, sets[lang]), lang) for i, lang in enumerate(["xx", "yy"] * 20)]
    model = langid.fit_languages(docs_of(train))
    df = np.zeros(langid.DIMS)
    for _, text, _ in train:
        df += langid.ngram_counts(text) > 0
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    assert np.allclose(model.idf, idf)
    for _, text, lang in train[:6]:
        v = np.log1p(langid.ngram_counts(text)) * idf
        v /= np.sqrt((v * v).sum())
        near = max((sum(a * b for a, b in zip(c, v)), name) for c, name in zip(model.centroids, model.langs))
        said, score, rejected = model.predict(text)
        assert said == near[1] == lang and abs(score - near[0]) < 1e-9 and not rejected


def test_texts_far_from_every_language_are_rejected(spark, docs_of):
    rng = random.Random(13)
    model = langid.fit_languages(docs_of([(i, _words(rng, 30, "abcd" if i % 2 else "efgh"), "xx" if i % 2 else "yy") for i in range(60)]))
    odd = docs_of([(1, _words(rng, 30, "abcd")), (2, "жщюя " * 30), (3, "12 34"), (4, None)])
    found = {r.doc_id: r.p for r in langid.predict_languages(odd, model, "p").collect()}
    assert not found[1].rejected and found[1].lang_pred == "xx"
    assert found[2].rejected and found[2].score < langid.REJECT_AT and found[2].lang_pred in ("xx", "yy")
    assert found[3].rejected and found[3].lang_pred == found[4].lang_pred == langid.UNKNOWN


def test_models_do_not_depend_on_the_order_of_repeated_ids(spark, docs_of):
    rng = random.Random(14)
    rows = [(i % 40, _words(rng, 20, "abcd" if i % 2 else "efgh"), "xx" if i % 2 else "yy") for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    langs = [langid.fit_languages(docs_of(r).repartition(n)) for r, n in ((rows, 3), (rows[::-1], 2))]
    assert np.array_equal(langs[0].centroids, langs[1].centroids)
    machines = [quality.fit_quality(docs_of(r).repartition(n), labels) for r, n in ((rows, 3), (rows[::-1], 2))]
    assert np.array_equal(machines[0].weights, machines[1].weights)


def test_languages_of_odd_rows(docs_of, odd):
    train = docs_of([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the", None), (4, None, "de")])
    found = langid.predict_languages(odd, langid.fit_languages(train)).select("doc_id", "prediction.*").collect()
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3, 9)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found) and len(found) == odd.count()
    empty = langid.fit_languages(train.limit(0))
    assert {r.l for r in langid.predict_languages(odd, empty).select(F.col("prediction.lang_pred").alias("l")).collect()} == {"und"}


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    text = "Ab c, déf 12 ghi. " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (langid.ngram_counts(text) == whole).all() and langid.ngram_counts("12 !") is None


# --- archives ------------------------------------------------------------------------

def test_archive_round_trip(spark):
    rows = [(5, "http://a/x y", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "u", None), (9, "u", ""), (7, "u", "z" * 200_000),
            (None, "u", "lone"), (8, "http://a/\r\nX: y", "é日"), (3, "r", "<p>one</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_sha", F.lit(0))
    found = warc.archive_round_trip(pages).collect()
    assert len(found) == len(rows)
    size = {i: len((h or "").encode()) for i, _, h in rows}
    for r in found:
        assert r.payload_bytes == size[r.page_id]
    assert {(r.page_id, r.record_type, r.refers_to) for r in found} == {
        (5, "revisit", 3), (3, "response", None), (4, "response", None), (9, "revisit", 4), (7, "response", None),
        (None, "response", None), (8, "response", None)}
    assert {r.payload_digest for r in found if r.page_id == 8} == {base64.b32encode(hashlib.sha1("é日".encode()).digest()).decode()}
    assert {r.record_type for r in warc.archive_round_trip(pages, min_bytes=11).collect()} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_archives_are_cut_and_begin_with_their_dictionary(spark):
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                    F.concat(F.lit("<html><p>some text in common "), "id").alias("html"))
    folder = run_path(spark, "warc-test")
    listed = warc.write_warc(pages.coalesce(1), folder, archive_bytes=20_000).collect()
    assert len(listed) > 1 and sum(r.records for r in listed) == 200
    raw = spark.read.format("binaryFile").load(folder).select("content").collect()
    assert all(bytes(r.content[:4]) == (0x184D2A5D).to_bytes(4, "little") for r in raw)
    assert warc.read_warc(spark, folder).count() == 200
    # As a second attempt would: other archives in the same folder. Those of the first are left over and not read.
    again = warc.write_warc(pages.repartition(2), folder, archive_bytes=9_000).collect()
    assert not {r.archive for r in listed} & {r.archive for r in again}
    assert spark.read.format("binaryFile").load(folder).count() == len(listed) + len(again)
    assert sorted(r.page_id for r in warc.read_warc(spark, folder).collect()) == list(range(200))


def test_the_dictionary_is_built_from_all_over_an_archive():
    rng = random.Random(3)
    records = [b"head " * 60_000] * 30 + [rng.randbytes(3000) for _ in range(600)]
    pieces = warc.sample(records)
    assert len({p for p in pieces if len(p) == 3000}) > 50 and max(map(len, pieces)) <= warc.PIECE_BYTES
    assert sum(map(len, pieces)) < warc.SAMPLE_BYTES + warc.PIECE_BYTES and warc.sample([]) == []


# --- tokens ---------------------------------------------------------------------------

def test_bpe_matches_the_library(docs_of, odd):
    import tiktoken
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(9)
    parts = ["a", "b", " ", "  ", "é", "ß", "日", "x1", "!!", "\n", "\t", "'s", "the", "ing", "12345", "🙂", "\x1c", " ", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(500)]
    texts += ["a" * 3000, "ab" * 900, "=" * 700, " " * 300, "é" * 400, "".join(rng.choice("abcdef") for _ in range(2000))]
    own = bpe.codec(RANKS, PATTERN)
    for text, packed in zip(texts, own.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(packed) == text.encode()
    found = {r.doc_id: r for r in bpe.encode_digests(odd, RANKS, PATTERN).collect()}
    assert found[1].n_tokens == 0 == found[2].n_tokens and found[2].decoded_sha256 == hashlib.sha256().hexdigest()
    ids = np.array(library.encode_ordinary("word " * 40_000), "<u4").tobytes()
    assert found[7].ids_sha256 == hashlib.sha256(ids).hexdigest()
    back = bpe.decode_column(bpe.encode_column(odd, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


def test_best_fit_decreasing_takes_the_fullest_row_that_fits():
    rng = random.Random(10)
    lengths = [rng.randint(1, 64) for _ in range(400)]
    rows, starts, n = packing.best_fit_decreasing(lengths, 64)
    room, slow = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room[room.index(min(fits))] -= lengths[i]
        else:
            room.append(64 - lengths[i])
    used = [0] * n
    for i, (r, s) in enumerate(zip(rows, starts)):
        used[r] += lengths[i]
    assert n == len(room) and sorted(64 - u for u in used) == sorted(room) and slow == [0] * len(lengths)


def test_pools_are_packed_once_however_the_result_is_used(spark, docs_of):
    folder = run_path(spark, "pack-lazy")
    docs = docs_of([(i, "some words to pack " * 20) for i in range(200)])
    found = packing.pack_documents(docs, folder, RANKS, PATTERN, 50256, pool_ids=500)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("path", "modificationTime")
    before = sorted(map(tuple, files.collect()))
    assert len(found.limit(1).collect()) == 1 and found.select("doc_id").distinct().count() == 200
    assert sorted(map(tuple, files.collect())) == before and len(before) == found.select("pool").distinct().count() > 20


def test_packed_files_hold_every_document(spark, odd):
    folder = run_path(spark, "pack-test")
    found = packing.pack_documents(odd, folder, RANKS, PATTERN, 50256, length=128, pool_ids=5000).collect()
    arrays = {p: packing.read_pool(folder, p) for p in {r.pool for r in found}}
    own, texts = bpe.codec(RANKS, PATTERN), {}
    for r in sorted(found, key=lambda r: (str(r.doc_id), r.pool, r.doc_start)):
        ids = arrays[r.pool]["ids"][r.pack_row, r.row_start:r.row_start + r.length]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        assert packing.positions(arrays[r.pool], r.pack_row)[r.row_start] == 0
        texts.setdefault(r.doc_id, []).extend(ids.tolist())
    for doc in (1, 2, 6, 7, 8, 9, None):
        (text,) = {t for d, t in [(r.doc_id, r.text) for r in odd.collect()] if d == doc}
        assert texts[doc][-1] == 50256
        assert own.decode(np.array(texts[doc][:-1], "<u4").tobytes()) == (text or "").encode()


# --- leaks and pages ----------------------------------------------------------------------

def test_leaks_match_a_search_for_the_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    norm = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if norm(i.text) in norm(d.text)}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == want and want
    left = {r.doc_id for r in decontam.decontaminate(docs, items).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_other_slot_values_are_caught_and_torn_ones_are_not(docs_of):
    ask = "if {a} sells {n} apples for {m} dollars each day and {b} buys {n} of them then how much does {b} owe {a} after {k} days"
    items = docs_of([(1, ask.format(a="Ann", b="Bob", n=12, m=3, k=5))]).withColumnRenamed("doc_id", "item_id")
    docs = docs_of([(1, "well " + ask.format(a="Zoe", b="Max", n=90, m=7, k=8) + " then"),
                    (2, "If Zoe sells 90 apples for 7 dollars each day and Max buys 91 of them then how much does Eve owe Tom after 8 days"),
                    (3, None), (4, ""), (None, ask), (5, "nothing of the kind is in this text at all, it is only about other things")])
    found = {r.doc_id: r for r in decontam.leaks(docs, items).collect()}
    assert found[1].coverage == 1.0 and not found[1].same_values
    assert 2 not in found or found[2].coverage < 1
    assert not {3, 4, 5, None} & set(found)
    assert decontam.leaks(docs.limit(0), items).count() == 0 == decontam.leaks(docs, items.limit(0)).count()
    assert decontam.decontaminate(docs, items.limit(0)).count() == 6


def test_number_words_and_units_of_four_languages_are_slots(docs_of):
    asks = [("Alice has {} apples and buys three more , so after 12 {} how long does she wait until the shop opens", "five", "nine", "days", "weeks"),
            ("wenn ein zug in {} stunden genau 300 {} weit fährt wie weit kommt er dann am ganzen tag ohne halt", "vier", "sieben", "kilometer", "meilen"),
            ("si une recette demande {} œufs et 200 {} de farine combien faut il acheter pour la faire encore une fois", "deux", "neuf", "grammes", "livres"),
            ("si un tanque pierde {} litros cada 5 {} cuánto queda después de llenar otra vez todo el tanque grande", "ocho", "doce", "minutos", "horas")]
    items = docs_of([(k, a.format(n, u)) for k, (a, n, _, u, _) in enumerate(asks)]).withColumnRenamed("doc_id", "item_id")
    docs = docs_of([(k, "x y " + a.format(n, u)) for k, (a, _, n, _, u) in enumerate(asks)])
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, items).collect()}
    assert set(found) == {(k, k) for k in range(4)} and not any(r.same_values for r in found.values())


def test_very_long_texts_and_clashing_columns_leak_like_others(docs_of):
    item = "the quick brown fox jumps over the lazy dog while nine other animals watch from the old barn in silence"
    items = docs_of([(1, item)]).withColumnRenamed("doc_id", "item_id").withColumn("hash", F.lit("x")).withColumn("at", F.lit(1))
    docs = docs_of([(1, "word " * 300_000 + item + " tail" * 1000), (2, "word " * 1000)]).withColumn("reading", F.lit("y")).withColumn("id", F.lit(0))
    assert [(r.doc_id, r.coverage) for r in decontam.leaks(docs, items).collect()] == [(1, 1.0)]


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, decontam.leaks(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 300)
    assert sorted(map(tuple, decontam.leaks(docs, items).collect())) == whole


def _plain_pairs(item, hit):
    """All pairs that share any window."""
    return hit.join(item, ["hash", "width", "reading"]).select("doc_id", "doc_copy", "item_id", "item_copy", "reading").distinct()


def test_a_window_of_many_items_and_documents_makes_few_pairs(spark, docs_of, monkeypatch):
    rng = random.Random(7)
    opening = "read the following passage with care and then answer the question that stands below it"
    ends = [_words(rng, rng.randint(20, 60)) for _ in range(40)]
    items = docs_of([(k, f"{opening} {e}") for k, e in enumerate(ends)]).withColumnRenamed("doc_id", "item_id")
    cut = lambda t, share: " ".join(t.split()[:int(len(t.split()) * share)])
    rows = [(k, f"{_words(rng, 4)} {opening} {_words(rng, 30)}") for k in range(100)]
    rows += [(100 + k, f"{_words(rng, 4)} {cut(e, rng.choice((0.3, 0.5, 0.7, 1.0)))} {_words(rng, 4)}") for k, e in enumerate(ends * 2)]
    rows += [(200 + k, f"{opening} {cut(e, 0.5)}") for k, e in enumerate(ends)]
    docs = docs_of(rows)
    made, real = [], decontam.candidates

    def counted(item, hit):
        found = real(item, hit)
        made.append((found.count(), _plain_pairs(item, hit).count()))
        return found
    monkeypatch.setattr(decontam, "candidates", counted)
    few = sorted(map(tuple, decontam.leaks(docs, items).collect()))
    monkeypatch.setattr(decontam, "candidates", _plain_pairs)
    assert few == sorted(map(tuple, decontam.leaks(docs, items).collect())) and few
    assert made[0][0] * 2 < made[0][1]


def test_candidates_lose_no_leak_of_the_tables(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    few = sorted(map(tuple, decontam.leaks(docs, items).collect()))
    monkeypatch.setattr(decontam, "candidates", _plain_pairs)
    assert few == sorted(map(tuple, decontam.leaks(docs, items).collect()))


def test_texts_that_share_an_id_leak_one_by_one(docs_of):
    item = "seven old ships with red sails left the quiet harbour before the storm came over the northern hills"
    words = item.split()
    items = docs_of([(1, item), (1, "another text of the same number that no document holds in any part at all")])
    rows = [(1, item), (1, "nothing of it here"), (2, " ".join(words[:9])), (2, " ".join(words[9:])), (1, item)]
    found = decontam.leaks(docs_of(rows), items.withColumnRenamed("doc_id", "item_id")).collect()
    assert [(r.doc_id, r.item_id, r.coverage, r.windows) for r in found] == [(1, 1, 1.0, len(words) - 7)]


def test_changed_names_that_begin_sentences_are_caught(docs_of):
    ask = "{a} has 5 apples. {b} has 3 apples. How many apples do {a} and {b} have?"
    short = "{a} sold 12 red kites today."
    items = docs_of([(1, ask.format(a="Alice", b="Bob")), (2, short.format(a="Alice")), (3, "What is the capital of France?")])
    docs = docs_of([(1, "well\n" + ask.format(a="Zoe", b="Max")), (2, "So. " + short.format(a="Zoe")), (3, "Paris is the capital of France."),
                    (4, ask.replace(". ", ".\n").format(a="Zoe", b="Max Frost")), (5, ask.format(a="Zoe", b="Zoe"))])
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, items.withColumnRenamed("doc_id", "item_id")).collect()}
    assert {(1, 1), (2, 2), (4, 1)} <= set(found) <= {(1, 1), (2, 2), (4, 1), (5, 1)}
    assert all(found[k].coverage == 1.0 and not found[k].same_values for k in ((1, 1), (2, 2), (4, 1)))


def test_verbatim_copies_of_any_case_and_few_words_are_caught(docs_of):
    few = "Add 12 34 56 78 90 21 43 65 and 87"
    named = "Then Ann saw Bob and Eve Fox met Tom while Sue and Kim told Max about Zoe or Liz and Pat left Jim"
    items = docs_of([(1, few), (2, named)]).withColumnRenamed("doc_id", "item_id")
    docs = docs_of([(1, f"so {few} now"), (2, named.lower()), (3, named.upper()), (4, named.replace(" ", "\n")),
                    (5, few.replace("34", "35").replace("65", "66"))])
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 2), (4, 2)}
    assert all(r.coverage == 1.0 and r.same_values for r in found.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style></head><body><header class="site"><h1>Site</h1></header>
<nav><a href=a>Home</a></nav><div id="cookie-notice">We use cookies</div><div class="wrap w%d"><div class="sidebar">See also</div>
<div class="post-body"><h2>T&amp;C</h2><p>Hello <b>wor</b>ld &lt;x&gt; &#233;<p>More   text%d here <script>var a="</p>";</script>and on.
<form><input> name</form><ul><li>one<li>two</ul></div><div class="comments"><p>Nice and long comment of a reader, longer than all</p></div>
</div><footer>f</footer>"""


def test_pages_of_a_host_agree_on_a_path(spark):
    rows = [(i, f"https://H.example:80/{i}", PAGE % (i, i)) for i in range(5)]
    rows += [(90, "https://h.example/t", "<body><div class='w9 wrap'><div class=post-body><p>Short</div><div class=other><p>" + "long " * 80),
             (91, None, None), (92, "x", ""), (93, "http://z/", "plain &amp; simple"), (94, "http://z/", "<p>un<closed")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    found = {r.page_id: r.main_text for r in extract.extract_text(pages).collect()}
    for i in range(5):
        assert found[i] == f"T&C\nHello world <x> é\nMore text{i} here and on.\none\ntwo"
    assert found[90] == "Short\n" + ("long " * 80).strip() and found[91] == found[92] == "" and found[93] == "plain & simple"
    assert extract.extract_text(pages.limit(0)).count() == 0


def test_wrappers_with_noise_in_their_names_keep_the_text():
    body = "<article><div class='entry-header'><h1>Head</h1></div><p>" + "Long text of it. " * 20 + "</article>"
    rest = "<div class='site-footer'>Foot</div><div class='related'><article>Teaser</article></div>"
    for wrap in ("div class='content has-sidebar'", "div class=no-sidebar", "div class=with-footer", "div id='legal-article'", "form",
                 "div class=widget"):
        for inner in (body, body.replace("article", "section")):
            found = extract.main_text(f"<body><{wrap}>{inner}</{wrap.split()[0]}>{rest if inner == body else ''}</body>", None)
            assert "Head" in found and found.count("Long text") == 20 and "Foot" not in found and "Teaser" not in found, wrap
    assert extract.main_text("<div class=post><p>Short post</div><div class=comments><p>" + "reply " * 5 + "</div>", None) == "Short post"


def test_text_beside_the_best_block_is_kept():
    lead = "<article><h1>Head</h1><p class=lead>The lead.</p><div class=body>%s</div></article>" % ("<p>Body text of it." * 40)
    two = "<div class=page><div class=intro><p>%s</div><div class=body><p>%s</div></div>" % ("intro " * 40, "body " * 72)
    links = "<div class=more>" + "<p><a href=x>Another page</a>" * 9 + "</div>"
    for html, parts in ((lead, ("Head", "The lead.", "Body text")), (two, ("intro", "body"))):
        page = f"<body><div class=wrap>{html}</div>{links}</body>"
        for found in (extract.main_text(page, None), extract.main_text(page, [extract.best_path(page)])):
            assert all(p in found for p in parts) and "Another" not in found


def test_an_article_outside_a_thin_winner_is_kept(spark):
    usual = "<html><body><div class=story><p>" + "Story text of the page. " * 40 + "</div><div class=more><a href=x>More</a></div>"
    odd = "<html><body><div class=story><p>Line.</div><section class=longread><p>" + "Long read. " * 300 + "</section>"
    rows = [(i, f"http://h/{i}", usual) for i in range(9)] + [(9, "http://h/9", odd)]
    found = extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.main_text for r in found}
    short = "<html><body><div class=ad>" + "Buy one. " * 40 + "</div><div class=story><p>Short.</div><div class=comments><p>" + "Reply. " * 90
    assert extract.main_text(short, ["html>body>div.story"]) == "Short."
    assert texts[9].startswith("Line.\nLong read.") and texts[9].count("Long read.") == 300
    assert texts[0].count("Story text") == 40 and "More" not in texts[0]


def test_formulas_objects_and_named_sections_of_an_article_are_kept():
    words = "Plain words of the article go on and on. " * 6
    page = ("<body><article><h1>Head</h1><p>Area is <math><mi>x</mi><mo>=</mo><mn>3</mn><annotation>tex</annotation></math> here.</p>"
            "<p>See <object>the drawing</object> too.</p><section class='search-results'><p>%s</p></section><div id=comment-on-law><p>On the law."
            "</p></div><aside class=pullquote><p>A quote.</p></aside><aside class=box><p>Aside.</p></aside><div class=post-comments><p>Reply."
            "</p></div><div class='social-share buttons'><p>Tell all.</p></div></article><aside class=pullquote>Out.</aside>" % words)
    text = extract.main_text(page, None)
    for part in ("Area is x=3 here.", "See the drawing too.", "Plain words", "On the law.", "A quote."):
        assert part in text
    for part in ("tex\n", "annotation", "Aside.", "Reply.", "Tell all.", "Out."):
        assert part not in text


def test_paths_with_equal_votes_are_taken_in_order(spark):
    pages = [("a", "<body><div class=b><p>" + "x " * 50), ("a", "<body><div class=a><p>" + "y " * 50)]
    rows = [(i, f"http://h/{i}", html) for i, (_, html) in enumerate(pages * 3)]
    paths = extract.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert [r.winners for r in paths] == [["body>div.a", "body>div.b"]]


class _Plain(HTMLParser):
    """Blocks by a general parser: whole tags, no noise but elements by name."""

    def __init__(self):
        super().__init__()
        self.depth, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style", "nav", "footer", "form", "title")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style", "nav", "footer", "form", "title")

    def handle_data(self, data):
        if not self.depth:
            self.text.append(data)


def test_extracted_blocks_are_blocks_of_the_page(spark):
    """Every block is text of the page in page order, and the container's blocks that are not skipped are all there."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract.extract_text(pages).select("html", "main_text").collect():
        plain = _Plain()
        plain.feed(r.html or "")
        whole, at = "".join("".join(plain.text).split()), 0
        for block in r.main_text.split("\n"):
            at = whole.find("".join(block.split()), at)
            assert at >= 0, block
        page = extract.parse(r.html)
        own = extract.container(page)
        inside = []
        for n, parent in enumerate(page.parents):
            inside.append(n == own or (parent >= 0 and inside[parent]))
        for n, block, linked in page.blocks:
            assert not inside[n] or page.skipped[n] or linked * 2 > len(block) or block in r.main_text.split("\n")


def test_hostile_markup_is_read_in_time():
    for html in ("<" * 200_000, "<div>" * 50_000 + "x", "<!--" * 50_000, "<a b='" * 20_000, "<script>" * 20_000, "&" * 200_000):
        extract.main_text(html, None)
