"""The llm operators against brute force, exact round trips and held-out accuracy, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quotemill.llm import byte_bpe, components, exact_dedup, fingerprints, language_id, mixing, near_dedup, queries, sharding, suffix_dedup, token_codec, token_files, toxicity
from quotemill.llm.textvec import words
from quotemill.llm.workspace import pieces, utf8_buffer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.5 else "") for _ in range(n))


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


AWKWARD = [None, "", " ", "a", "ß'll\n\n x", "one two three four", prose(1, 400), prose(1, 400), prose(2, 3000), "x" * 5000, "  \t", "'s's''s", "\x00\x00", "😀 " * 60]


def awkward(spark):
    """Nulls in every column, repeated rows, ties, empty and long texts, and extra columns named like results."""
    d = table(spark, AWKWARD)
    d = d.union(spark.createDataFrame([(3, "a", None, None, None), (3, "a", None, None, None), (None, "null id text", None, None, None), (None, None, None, None, None)], SCHEMA))
    return d.withColumn("score", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("kept", F.lit(0)).withColumn("fingerprint", F.lit(0)).withColumn("class_id", F.lit(7)).withColumn("rid", F.lit(7)).withColumn("chunk", F.lit(7)).withColumn("text_sha256", F.lit(7))


RUNS = {
    1: near_dedup.near_duplicates, 2: byte_bpe.round_trip_digests, 3: sharding.shard_rows, 4: token_files.round_trip, 6: suffix_dedup.dedup_substrings, 9: exact_dedup.exact_dedup, 10: fingerprints.compare_edits,
}


@pytest.mark.parametrize("op", RUNS)
def test_awkward_and_empty_tables(spark, op):
    d = awkward(spark)
    assert RUNS[op](d).count() == d.count()
    assert RUNS[op](d.limit(0)).count() == 0


# ---------------------------------------------------------------- 1

ALONE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]")


def own_words(text):
    """Words letter by letter: runs of letters, marks and digits, or single characters of scripts without spaces."""
    out, run = [], ""
    for c in text + " ":
        word = c.isascii() and c.isalnum() or not c.isascii() and unicodedata.category(c)[0] in "LMN"
        if word and not ALONE.match(c):
            run += c
            continue
        if run:
            out.append(run)
        run = ""
        if word:
            out.append(c)
    return out


def brute_classes(ids, texts):
    def grams(t):
        w = own_words((t or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets, parent = [grams(t) for t in texts], list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            low = sum((sets[i] & sets[j]).values())
            if low and low / sum((sets[i] | sets[j]).values()) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


def test_near_duplicates_equal_brute_force(spark):
    texts = [prose(k, 120) for k in range(12)]
    r = random.Random(5)
    chain = prose(99, 300).split()
    for _ in range(40):  # a drifting family: neighbours are alike, ends are not
        for _ in range(4):
            chain[r.randrange(len(chain))] = r.choice(WORDS) + "x"
        texts.append(" ".join(chain))
    for k in range(30):
        w = texts[k % 12].split()
        for _ in range(r.choice([1, 2, 6])):
            w[r.randrange(len(w))] = "new"
        texts.append(" ".join(w))
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_classes(list(range(len(texts))), texts)


@pytest.mark.parametrize("rows, size", [(1024, 8 << 20), (7, 4000)])
def test_a_cloud_of_near_copies_is_settled_exactly(spark, monkeypatch, rows, size):
    """Copies of one text, each changed at so many places that about half of the pairs are alike: units of one block, and of many."""
    monkeypatch.setattr(near_dedup, "UNIT_ROWS", rows)
    monkeypatch.setattr(near_dedup, "UNIT_BYTES", size)
    r, texts = random.Random(8), []
    for k in range(90):
        w = prose(77, 150).split()
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(table(spark, texts)).collect()}
    want = brute_classes(list(range(len(texts))), texts)
    assert got == want and 1 < len(set(want.values())) < 60


def test_near_copies_without_spaces(spark):
    r = random.Random(3)
    a, b = ("".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(600)) for _ in range(2))
    thai = "".join(chr(r.randrange(0xE01, 0xE2F)) for _ in range(600))
    texts = [a, b, a[:300] + "中" + a[301:], thai, thai[:100] + thai[101:], a.replace(a[5], "、"), "one\u00a0two，three four five six", "one two three four five six"]
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_classes(list(range(len(texts))), texts) == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 0, 6: 6, 7: 6}


def test_rows_that_share_a_doc_id_are_one_document(spark):
    x, y = prose(1, 60), prose(2, 60)
    rows = [(1, x), (1, y), (2, x + " end"), (3, y + " end"), (4, prose(3, 60)), (4, prose(3, 60)), (None, x), (5, ""), (6, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_dedup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (None, None, True), (5, 5, True), (6, 6, True)], key=str)


def brute_links(texts):
    """All pairs at 0.8 or more: two such texts share one of the rarest fifth (and one more) of their shingles."""
    grams = []
    for t in texts:
        w = own_words((t or "").lower())
        c = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        grams.append({(g, k) for g, n in c.items() for k in range(n)})
    seen = Counter(g for s in grams for g in s)
    lists = {}
    for i, s in enumerate(grams):
        for g in sorted(s, key=lambda g: (seen[g], g))[: len(s) - math.ceil(0.8 * len(s)) + 1]:
            lists.setdefault(g, []).append(i)
    out, tried = set(), set()
    for own in lists.values():
        for p, i in enumerate(own):
            for j in own[:p]:
                if (j, i) not in tried:
                    tried.add((j, i))
                    if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                        out.add((j, i))
    return out


def test_recall_on_the_tables(spark):
    """The whole of sf0.1: every link that brute force finds is inside a class, and classes have no more than the links give."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    distinct = {}
    for i, t in rows:
        distinct.setdefault(t or "", i)
    ids, texts = list(distinct.values()), list(distinct)
    links = [(ids[a], ids[b]) for a, b in brute_links(texts)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [*links, *((distinct[t or ""], i) for i, t in rows if own_words(t or ""))]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert len(links) > 50 and got == {i: root(i) for i in got}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    z = []
    for _ in range(40):
        n = int(rng.integers(5, 300))
        base, wa = rng.integers(0, 1 << 62, n).astype(np.uint64), rng.geometric(0.5, n)
        wb = np.maximum(0, wa + rng.integers(-2, 3, n))
        a, b = np.repeat(base, wa), np.repeat(base, wb)
        j = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        s = near_dedup.signatures(np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2)
        z.append(((s[0] == s[1]).mean() - j) / max(0.02, np.sqrt(j * (1 - j) / near_dedup.REGISTERS)))
        x, y = near_dedup.multiset_keys(np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2)
        both = near_dedup.shared_shingles(x, [y])[0]
        assert both / (len(x) + len(y) - both) == pytest.approx(j) and near_dedup.linked(x, [y])[0] == (j >= 0.8)
    assert abs(np.mean(z)) < 0.6 and np.std(z) < 1.6


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 40), (40, 35), (50, 50)], "a bigint, b bigint")
    got = dict(components.components(e).collect())
    assert got == {i: 0 for i in range(21)} | {30: 30, 35: 30, 40: 30}


def test_components_write_few_files(spark, monkeypatch):
    """With many shuffle partitions the steps after the first are written by few tasks, and stars end at once."""
    sizes, write = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df, name: (out := write(df, name), sizes.append(len(out.inputFiles())))[0])
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        r = random.Random(5)
        chains = [(1000 * c + x, 1000 * c + x + 1) for c in range(10) for x in range(60)]
        r.shuffle(chains)
        got = dict(components.components(spark.createDataFrame(chains, "a bigint, b bigint")).collect())
        assert got == {1000 * c + x: 1000 * c for c in range(10) for x in range(61)}
        assert len(sizes) > 1 and max(sizes[1:]) <= 8
        sizes.clear()
        star = [(x, 0) for x in range(1, 300)]
        assert dict(components.components(spark.createDataFrame(star, "a bigint, b bigint")).collect()) == dict.fromkeys(range(300), 0)
        assert len(sizes) == 1
        assert components.components(spark.createDataFrame([(3, 3)], "a bigint, b bigint")).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ---------------------------------------------------------------- 2, 4

def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    r = random.Random(1)
    parts = ["'s", "'re", "'ll", "'", "''", " ", "  ", "\n", "\r\n", " ", "a", "Z", "é", "9", "²", "!", "...", "’", "　", "́", "中", "😀", "v", "e", "r", "<|endoftext|>", "\x1c", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)] + ["ab" * 3000, prose(3, 200)]
    cache, decoder = byte_bpe._codec(path)
    ids, at, _, _ = byte_bpe.encode_texts(texts, cache)
    for k, t in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        assert own.tolist() == enc.encode_ordinary(t)
        assert decoder.decode(own.astype(np.int64)) == t.encode()
    d = table(spark, texts[-5:] + [None])
    back = byte_bpe.decode(byte_bpe.encode(d)).collect()
    assert [bytes(x.decoded).decode() for x in back] == [x.text or "" for x in back]
    digest = {x.doc_id: x for x in byte_bpe.round_trip_digests(d).collect()}
    assert all(digest[x.doc_id].ids_sha256 == hashlib.sha256(np.array(x.ids, "<u4").tobytes()).hexdigest() and digest[x.doc_id].n_tokens == len(x.ids) for x in back)


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 4097, 9000])
def test_codec_round_trip_and_checksums(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50257).astype(np.uint32)
    blob = token_codec.encode(ids)
    assert (token_codec.decode(blob) == ids).all()
    if n > 100:
        assert len(blob) < 2.2 * n
        bad = bytearray(blob)
        bad[-40] ^= 1
        with pytest.raises(token_codec.Corrupt):
            token_codec.decode(bytes(bad))


def test_codec_blocks_are_independent_and_beat_zlib():
    cache, matched = token_files._cache(None, True)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    ids = token_files.with_end(*token_files.encode(texts, cache, matched)).astype(np.uint32)
    blob = token_codec.encode(ids)
    assert (token_codec.decode(blob) == ids).all()
    assert len(blob) < 0.93 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    every = (np.arange(1 << 16) * 40503 % (1 << 16)).astype(np.uint32)
    assert (token_codec.decode(token_codec.encode(every)) == every).all()


def test_codec_reports_damage_anywhere():
    ids = (np.random.default_rng(3).zipf(1.3, 5000) % 50257).astype(np.uint32)
    blob = token_codec.encode(ids)
    for at in [0, 9, token_codec.HEAD + 3, len(blob) // 3, len(blob) // 2, len(blob) - 40]:
        bad = bytearray(blob)
        bad[at] ^= 4
        with pytest.raises(token_codec.Corrupt):
            token_codec.decode(bytes(bad))
    with pytest.raises(token_codec.Corrupt):
        token_codec.decode(blob[:-4])


def test_codec_takes_little_time_an_id():
    """CPU microseconds to encode and decode an id, on a machine that takes 1.2 ms for the loop that it is compared with."""
    import time

    def cpu(run):
        began = time.thread_time()
        run()
        return time.thread_time() - began

    ids = (np.random.default_rng(5).zipf(1.3, 3 << 20) % 30000).astype(np.uint32)
    least = min(cpu(lambda: token_codec.decode(token_codec.encode(ids))) for _ in range(2))
    slow = sorted(cpu(lambda: sum(range(50_000))) for _ in range(99))[49] / 0.0012
    assert least / len(ids) * 1e6 / slow < 0.6


def test_pieces_at_hand_are_looked_up_once():
    """A full cache keeps the pieces of the texts at hand, and each distinct piece goes to the library once."""
    cache, matched = token_files._cache(None, True)
    texts = [prose(k, 40) + f" {k}\0 é😀\n" for k in range(20)]
    want = token_files.encode(texts, cache, matched)
    asked, library, limit = [], cache.encode_new, cache.limit
    try:
        cache.encode_new, cache.limit = lambda new: asked.extend(new) or library(new), 10
        cache.reset()
        for _ in range(3):
            ids, at = token_files.encode(texts, cache, matched)
            assert (ids == want[0]).all() and (at == want[1]).all()
    finally:
        cache.encode_new, cache.limit = library, limit
    assert len(asked) == len(set(asked)) > 10
    assert ids.tolist() == [i for t in texts for i in cache.encode_whole([t])[0]]


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [prose(k, 50) for k in range(6)] + [None, "", "<|endoftext|> it's", "é\n\n 12"]
    got, at = {x.doc_id: x for x in token_files.round_trip(table(spark, texts)).collect()}, 0
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_have_no_small_last_chunk(spark, tmp_path):
    """A part's ids beyond a chunk's size stay with its last chunk, and pieces go to the library's model as in whole texts."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [prose(k, 40) + f" {k * 7919} é😀\n\xad\x7f\xa0" for k in range(300)]
    own = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    total = sum(map(len, own))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, shuffles = spark.conf.get(batch), spark.conf.get("spark.sql.shuffle.partitions")
    for size, several in ((total - 100, False), (total // 4, True)):
        path = f"file://{tmp_path}/{size}"
        try:
            spark.conf.set(batch, "20")
            spark.conf.set("spark.sql.shuffle.partitions", "1")
            token_files.write(table(spark, texts), path, chunk_ids=size, added=True)
        finally:
            spark.conf.set(batch, before)
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        sizes = [sum(x.counts) for x in spark.read.parquet(path).orderBy("chunk").collect()]
        assert (len(sizes) > 1) == several and max(sizes) <= 2 * size and sum(sizes) == total
        assert not several or sizes[-1] >= size
        got = sorted((x.doc_id, x.ids) for x in token_files.read(spark, path).collect())
        assert [ids for _, ids in got] == own


def test_token_files_match_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["it's", "a <|endoftext|> b", None, "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n 12", "<|endoftext", prose(1, 50)]
    assert t.encode(texts[1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got, at = {x.doc_id: x for x in queries.op4_token_files(spark, str(tmp_path)).collect()}, 0
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# ---------------------------------------------------------------- 3

@pytest.mark.parametrize("n", [1, 2, 7, 100, 997])
def test_sharding_is_a_permutation(spark, n):
    d = table(spark, [f"t{i}" for i in range(n)])
    got = sharding.shard_rows(d).toPandas()
    sizes = got.groupby("shard").size().reindex(range(24), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got.text_crc32.tolist() == [zlib.crc32(f"t{i}".encode()) for i in got.doc_id]
    again = sharding.shard_rows(d.repartition(3)).toPandas()
    assert got.set_index("doc_id").shard.sort_index().tolist() == again.set_index("doc_id").shard.sort_index().tolist()
    if n > 500:
        assert sorted(got.doc_id) != got.sort_values(["slot", "shard"]).doc_id.tolist()


# ---------------------------------------------------------------- 5

def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(1, 900)), [float(p), float(1 - p)]) for i, p in enumerate(rng.beta(0.3, 0.3, 500))]
    t = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, posterior array<double>")
    rate, report = mixing.fit_rates(t, ["a", "b"], {"a": 0.8, "b": 0.2})
    got = np.array(report["after"]) / sum(report["target"])
    assert abs(got - [0.8, 0.2]).max() < 5e-3
    assert t.select(F.min(rate)).first()[0] >= 0
    assert t.withColumn("n_tokens", F.lit(0)).select(F.max(rate)).first()[0] == 1.0


def test_mixing_equals_plain_projected_gradient(spark):
    """On the posteriors of real documents: the same steps on plain arrays give every document's rate."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = mixing.mix_rates(docs, labels).toPandas().sort_values("doc_id")
    p, n = np.array(got.posterior.tolist()), got.n_tokens.to_numpy(float)
    domains = mixing.train(docs, labels).domains
    want = np.array([mixing.TARGETS[d] for d in domains])
    want, total = want / want.sum(), (n[:, None] * p).sum()
    inverse = np.linalg.pinv((n[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0) / total + 1e-6 * np.eye(len(domains)))
    rate = np.ones(len(n))
    for _ in range(mixing.STEPS):
        gap = ((rate * n) @ p - want * total) / total
        if np.abs(gap).max() < 1e-4:
            break
        rate = np.where(n > 0, np.maximum(0, rate - mixing.STEP * (p @ (inverse @ gap)) - mixing.PULL * (rate - 1)), 1.0)
    assert np.abs(got.rate.to_numpy() - rate).max() < 1e-4
    assert np.abs((rate * n) @ p / total - want).max() < 0.02
    assert got.groupby("domain").domain_after.nunique().max() == 1


def test_mixing_on_awkward_tables(spark):
    labels = spark.createDataFrame([(6, 1, 0), (8, 0, 1), (5, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    d = awkward(spark)
    assert mixing.mix_rates(d, labels).count() == d.count()
    assert mixing.mix_rates(d, labels.limit(0)).select("domain").distinct().count() == 1
    clash = d.withColumn("_n_tokens", F.lit(1)).withColumn("n_tokens", F.lit(2)).withColumn("_posterior", F.lit(3)).withColumn("posterior", F.lit(4)).withColumn("_row", F.lit(5)).withColumn("_copy", F.lit(6))
    assert mixing.resample(clash, labels).columns == clash.columns
    kept = mixing.resample(d, labels, keep=("q1_t0", "q0_t1"))
    assert kept.columns == d.columns and kept.select("doc_id", "text").distinct().count() == d.select("doc_id", "text").distinct().count()


# ---------------------------------------------------------------- 6

def brute_spans(ids, texts):
    first, out = {}, {}
    for i, t in sorted(zip(ids, texts)):
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], i)
    for i, t in zip(ids, texts):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i] = (len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_equal_brute_force(spark):
    r = random.Random(2)
    shared = [prose(200 + k, 14) for k in range(5)]
    texts = []
    for k in range(60):
        parts = [prose(300 + k, r.randrange(30)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            a = r.randrange(30)
            parts.insert(r.randrange(len(parts)), s[a : a + r.choice([48, 49, 50, 51, 90])])
        texts.append("".join(parts))
    texts += ["%" * 70, "%" * 49, "%" * 60, "ab" * 40, "é" * 40, "aé" * 30, "é" * 26, "\x00" * 55, "\x00" * 55, texts[0], texts[0] + "!", "x" + texts[1]]
    want = brute_spans(list(range(len(texts))), [t.encode() for t in texts])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup_substrings(table(spark, texts)).collect()}
    assert got == want


def test_hot_kmers_take_the_local_way(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LOCAL", 2)
    texts = [prose(7, 20) + prose(500 + k, 5) for k in range(20)]
    want = brute_spans(list(range(20)), [t.encode() for t in texts])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup_substrings(table(spark, texts).coalesce(1)).collect()}
    assert got == want


def test_multikey_sort():
    t = np.random.default_rng(0).integers(0, 3, (500, 5)).astype(np.uint64)
    assert t[suffix_dedup.multikey_sort(t)].tolist() == sorted(t.tolist())


# ---------------------------------------------------------------- 7, 8

def test_toxicity_finds_unseen_spellings():
    r = random.Random(4)
    bad = ["wretched", "horrible", "scoundrel"]
    sample = []
    for k in range(600):
        w = prose(k, 40).split()
        if k % 3 == 0:
            w[r.randrange(40)] = r.choice(bad)
        sample.append(("1" if k % 3 == 0 else "0", " ".join(w)))
    m = toxicity.fit(sample)
    score = lambda texts: m.scores(toxicity.text_logits(m, *utf8_buffer(pa.array([t.lower() for t in texts]))))
    clean, toxic = [prose(9000 + k, 40) for k in range(50)], [prose(9500 + k, 40) + " " + r.choice(bad) for k in range(50)]
    assert (score(clean) >= 0.7).mean() < 0.05 and (score(toxic) >= 0.7).mean() > 0.95
    assert score(["wretchedd horible"])[0] > np.median(score(clean))
    assert score(["", "!!"]).tolist() == [0.0, 0.0]
    assert toxicity.fit([("0", "a")]).scores(np.array([1.0]))[0] == 0.0


def test_toxicity_and_language_on_awkward_tables(spark):
    d = awkward(spark)
    labels = spark.createDataFrame([(6, 0), (8, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    for marks in (labels, labels.limit(0)):
        out = toxicity.score(d, toxicity.train(d, marks))
        assert out.count() == d.count() and out.columns.count("score") == 1
    for docs in (d, d.limit(0)):
        out = language_id.identify(d, language_id.train(docs))
        assert out.count() == d.count()
        assert out.filter("doc_id = 1").first().lang_pred == "und" and out.filter("doc_id = 1").first().rejected


def test_language_models_sum_to_one_and_separate():
    r = random.Random(6)
    tongues = {"aa": "ka ki ku ra ri mo".split(), "bb": "str end ing olf che ung".split()}
    make = lambda k, n: " ".join("".join(r.choice(tongues[k]) for _ in range(3)) for _ in range(n))
    m = language_id.fit([(k, make(k, 60)) for k in tongues for _ in range(60)])
    text = [make(k, 30) for k in ("aa", "bb") for _ in range(50)]
    lang, score, _, rejected = language_id.score(m, text)
    assert lang == ["aa"] * 50 + ["bb"] * 50 and not rejected.any() and score.min() > 0.9
    assert language_id.score(m, ["qqxx zzww vvjj qxzw"])[3][0]
    for before in ("ka ", "stre", "q", "ou"):  # every context's probabilities add up over the letters seen and one unseen
        every = [before + c for c in sorted(set("".join(t for _, t in sample_of(make, tongues))) - {" "})] + [before + "\u4e2d"]
        sym, off = language_id.symbols_of(every)
        grams, contexts = language_id.ngrams(sym, off)
        lp = m.log_probabilities(grams[off[1:] - 1], contexts[off[1:] - 1])
        assert np.exp(lp.astype(float)).sum(0) == pytest.approx(1, abs=1e-3)


def sample_of(make, tongues):
    return [(k, make(k, 60)) for k in tongues for _ in range(60)]


class PlainKneserNey:
    """The same model with dictionaries of strings, from its definition."""

    def __init__(self, texts, alphabet, order=4):
        self.order, self.alphabet, self.counts = order, alphabet, [Counter() for _ in range(order + 1)]
        for t in texts:
            s = ["#"] * order + [c if unicodedata.category(c)[0] == "L" else "#" for c in t.lower()]
            for i in range(order, len(s)):
                if s[i] != "#":
                    self.counts[order][tuple(s[i - order + 1 : i + 1])] += 1
        for m in range(order - 1, 0, -1):
            for g in self.counts[m + 1]:
                self.counts[m][g[1:]] += 1
        self.discount, self.total, self.kinds = [0] * (order + 1), [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        for m in range(1, order + 1):
            of = Counter(self.counts[m].values())
            self.discount[m] = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
            for g, n in self.counts[m].items():
                self.total[m][g[:-1]] += n
                self.kinds[m][g[:-1]] += 1

    def p(self, gram):
        p = 1 / self.alphabet
        for m in range(1, self.order + 1):
            g = gram[self.order - m :]
            total = self.total[m][g[:-1]]
            if total:
                p = max(0, self.counts[m][g] - self.discount[m]) / total + self.discount[m] * self.kinds[m][g[:-1]] / total * p
        return p

    def entropy(self, text):
        s = ["#"] * self.order + [c if unicodedata.category(c)[0] == "L" else "#" for c in text.lower()]
        lp = [math.log(self.p(tuple(s[i - self.order + 1 : i + 1]))) for i in range(self.order, len(s)) if s[i] != "#"]
        return -sum(lp) / len(lp)


def test_language_models_equal_plain_kneser_ney():
    r = random.Random(16)
    tongues = {"el": "αβγδε λόγος και το", "en": "the of and to prose", "ja": "これは本です 日本語", "ru": "это и не дом мир"}
    make = lambda k, n: " ".join(r.choice(tongues[k].split()) + r.choice(tongues[k]) for _ in range(n)) + "!"
    sample = [(k, make(k, 20)) for k in sorted(tongues) for _ in range(9)]  # fewer than ten texts: all count
    m = language_id.fit(sample)
    alphabet = 1 + len({c for _, t in sample for c in t.lower() if unicodedata.category(c)[0] == "L"})
    plain = {k: PlainKneserNey([t for j, t in sample if j == k], alphabet) for k in tongues}
    texts = [make(k, 6) for k in sorted(tongues) for _ in range(5)] + ["the 日本 дом", "xyzzy", "A1b2"]
    lang, _, h, _ = language_id.score(m, texts)
    for t, k, x in zip(texts, lang, h):
        every = {j: plain[j].entropy(t) for j in plain}
        assert x == pytest.approx(min(every.values()), rel=1e-4) and every[k] == pytest.approx(min(every.values()), rel=1e-6)


def test_language_held_out_accuracy(spark):
    """Of the documents of sf0.1 that the fit has not seen 99 % or more are right, and no more than 0.5 % rejected."""
    out = queries.op8_language_id(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right, rejected = out.filter("held_out AND lang IS NOT NULL").agg(F.count("*"), F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 1500 and right >= 0.99 * n and rejected <= 0.005 * n


def test_no_short_document_of_a_known_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang IS NOT NULL")
    found = language_id.identify(docs.select("doc_id", "text", "lang"), language_id.train(docs))
    short = [r for r in found.filter("lang_pred = lang AND length(text) < 120").select("text", "rejected").collect() if sum(c.isalpha() for c in r.text) < language_id.SLICE]
    assert len(short) > 200 and not any(r.rejected for r in short)


# ---------------------------------------------------------------- 9, 10

def test_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    a = exact_dedup.DigestIndex(spark, path, 4).dedup(table(spark, ["x y", "xy", "z", None, ""])).toPandas().set_index("doc_id").sort_index()
    assert a.keep_id.tolist() == [0, 0, 2, 3, 3] and a.kept.tolist() == [True, False, True, True, False] and a.group_size.tolist() == [2, 2, 1, 2, 2]
    later = exact_dedup.DigestIndex(spark, path, 4)
    new = table(spark, ["z ", "w", "w"]).withColumn("doc_id", F.col("doc_id") + 100)
    for _ in range(2):  # given again by its name, a batch gets the same answer and adds nothing
        b = later.dedup(new, "second").toPandas().set_index("doc_id").sort_index()
        assert b.keep_id.tolist() == [2, 101, 101] and b.kept.tolist() == [False, True, False] and b.group_size.tolist() == [1, 2, 2]
        assert later.rows().count() == 4
    assert not later.dedup(new, "third").filter("kept").count()
    plan = later.unseen(exact_dedup.groups(exact_dedup.digests(new)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    later.forget()


def test_a_batch_that_died_after_the_append_keeps_its_rows(spark, tmp_path, monkeypatch):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/died", 4)
    docs = table(spark, [f"text {k % 40}" for k in range(50)])
    append = index.append

    def dies(fresh, batch):
        append(fresh, batch)
        raise RuntimeError("lost")

    monkeypatch.setattr(index, "append", dies)
    with pytest.raises(RuntimeError):
        index.dedup(docs, "monday")
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/died", 4).dedup(docs, "monday")
    assert again.filter("kept").count() == 40 and sorted(r.doc_id for r in again.filter("kept").collect()) == list(range(40))
    index.forget()


def test_no_table_is_left_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.keep_distinct(table(spark, ["a", "a "])).collect()
    exact_dedup.exact_dedup(table(spark, ["a", "a "])).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_keep_distinct_prefers_the_longest_original(spark):
    rows = [(1, "xy"), (1, "x  y"), (1, "x y "), (2, "x   "), (2, "   x"), (3, "x   "), (None, "n"), (None, "n"), (None, "n ")]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id bigint, text string").withColumn("digest", F.lit(1)).withColumn("own", F.lit(2)).withColumn("_row", F.lit(3)).repartition(3)
        out = exact_dedup.keep_distinct(d)
        assert out.columns == d.columns
        got = sorted((r.doc_id or 0, len(r.text)) for r in out.collect())
        assert got == [(0, 2), (1, 4), (2, 4)]


def test_hot_groups_of_copies_get_the_same_answer_by_broadcast(spark, monkeypatch):
    texts = ["hot copy", " hot  copy", "", None, "twice", "twice ", *[f"single {k}" for k in range(20)]]
    d = table(spark, texts * 3 + ["hot copy"] * 40 + [""] * 30)
    # Two rows with the id and text of one that stays, so that repeats fall into a hot group as well.
    best = exact_dedup.exact_dedup(d).filter("text_sha256 = sha2('hotcopy', 256) AND kept").first().keep_id
    d = d.union(d.filter(F.col("doc_id") == best)).union(awkward(spark).select(*d.columns))
    plain = sorted(map(str, exact_dedup.exact_dedup(d).collect()))
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    for share in (0.0, 0.25, 0.001):
        monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
        assert sorted(map(str, exact_dedup.exact_dedup(d).collect())) == plain
        assert exact_dedup.keep_distinct(d).count() == len({r.text_sha256 for r in exact_dedup.exact_dedup(d).collect()})


def test_keep_distinct_keeps_one_of_identical_rows(spark):
    d = awkward(spark)
    out = exact_dedup.keep_distinct(d)
    assert out.columns == d.columns
    normal = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in [*AWKWARD, "null id text"]}
    assert out.count() == len(normal)


def test_fingerprints(spark):
    texts = [prose(k, 200) for k in range(8)] + [prose(3, 200), "", None, "é"]
    got = {x.doc_id: x for x in fingerprints.compare_edits(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[3].fingerprint == got[8].fingerprint and got[9].fingerprint == got[10].fingerprint
    assert all(got[i].near_edited > 0.4 > got[i].near_next for i in range(7))
    assert fingerprints.likeness(fingerprints.unpack(got[3].fingerprint), fingerprints.unpack(got[8].fingerprint)) == 1.0


def test_fingerprints_keep_every_anchor():
    passage = prose(50, 40)
    a, b = (f"{prose(k, 2000)} {passage} {prose(k + 10, 2000)}" for k in (60, 80))
    sketches = [fingerprints.unpack(fingerprints.pack(s)) for s in fingerprints.sketch_many([a, b])]
    for text, (h, places) in zip((a, b), sketches):
        raw = text.encode()
        at, every = fingerprints.syncmers(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert h.tolist() == every.tolist() and places.tolist() == at.tolist() and len(h) > 1000
    in_passage = set(fingerprints.sketch_many([passage])[0][0].tolist())
    assert len(in_passage) >= 20 and all(in_passage <= set(s[0].tolist()) for s in sketches)
    assert fingerprints.likeness(*sketches) >= 0.9 * len(in_passage) / sum(len(s[0]) for s in sketches)


def test_fingerprints_come_back_whole_and_stay_short():
    lines = "".join(f"the same line again, number {k % 3}\n" for k in range(400))
    texts = ["", "é", "abcd", "abcde", prose(5, 12), prose(5, 20), prose(5, 3000), lines, "x" * 3000, "é😀" * 300]
    for text, sketch in zip(texts, fingerprints.sketch_many(texts)):
        packed = fingerprints.pack(sketch)
        assert [x.tolist() for x in fingerprints.unpack(packed)] == [x.tolist() for x in sketch]
        assert len(text) < fingerprints.SHORT or len(packed) < 0.9 * len(text.encode())


def plain_likeness(a, b):
    """The definition of likeness with lists and loops."""
    slack, short = fingerprints.SLACK, int(fingerprints.SHORT_BIT)
    a, b = ([(int(h), int(p)) for h, p in zip(*s)] for s in (a, b))
    if not a or not b:
        return float(len(a) == len(b))
    if (a[-1][0] < short) != (b[-1][0] < short):
        a, b = ([x for x in s if x[0] < short] for s in (a, b))

    def ranked(a, b, last=False):
        out = []
        for h in sorted({h for h, _ in a} & {h for h, _ in b}):
            p, q = (sorted((x for k, x in s if k == h), reverse=last) for s in (a, b))
            out += [(h, x, y) for x, y in zip(p, q)]
        return out

    both = {h for h, _ in a} & {h for h, _ in b}
    if not both:
        return 0.0
    best = None
    for last in (False, True):
        shifts = sorted(y - x for _, x, y in ranked(a, b, last))
        crowds = [[v for v in shifts if abs(v - s) <= slack] for s in shifts]
        crowd = max(crowds, key=len)
        if best is None or len(crowd) > best[0]:
            counts = Counter(crowd)
            best = len(crowd), min(counts, key=lambda v: (-counts[v], v))
    main = best[1]

    def nearest(h, want, s):
        d = [(abs(p - want), p) for k, p in s if k == h]
        return min(d)[1] if d and min(d)[0] <= slack else None

    pairs = []
    for h, p in a:
        q = nearest(h, p + main, b) if h in both else None
        if q is not None and nearest(h, q - main, a) == p:
            pairs.append((h, p, q))
    used, met = {(h, p) for h, p, _ in pairs}, {(h, q) for h, _, q in pairs}
    rest = ranked([x for x in a if x not in used], [x for x in b if x not in met])
    line = sorted([(p, h, q - p, True) for h, p, q in pairs] + [(p, h, q - p, False) for h, p, q in rest])
    agree = lambda i, j: 0 <= j < len(line) and abs(line[i][2] - line[j][2]) <= slack
    n = sum(x[3] or agree(i, i - 1) or agree(i, i + 1) for i, x in enumerate(line))
    return n / (len(a) + len(b) - n)


def test_likeness_equals_its_definition():
    r = random.Random(3)
    few = lambda n: " ".join(r.choice(WORDS[:3]) for _ in range(n))
    line = "a line that comes again and again\n"
    texts = ["", "é", "ab", prose(1, 8), prose(1, 12), prose(2, 300), prose(3, 300), few(15), few(200), few(300), line * 40, "x" * 400, "yx" * 200]
    texts += [line * 10 + prose(4, 60) + line * 20, prose(4, 60) + line * 25, prose(2, 300)[500:] + prose(2, 300)[:500], few(100) + prose(2, 300) + few(50)]
    texts += [fingerprints.edited(t, u) for t, u in zip(texts, texts[1:])] + [t[len(t) // 3 :] for t in texts if len(t) > 100]
    sketches = fingerprints.sketch_many(texts)
    seen = set()
    for s in sketches:
        assert fingerprints.likeness(s, s) == 1.0
        for o in sketches:
            got = fingerprints.likeness(s, o)
            assert got == plain_likeness(s, o)
            seen.add(round(got, 1))
    assert {0.0, 0.1, 0.5, 0.6, 1.0} <= seen


def test_texts_that_repeat_lines_or_words_stay_like_their_edits():
    lines = "".join(f"log line {k % 7}: nothing of note has come to pass today\n" for k in range(500))
    for text in (lines, "spam and eggs, " * 600, prose(1, 40) * 50, prose(2, 500) + lines):
        a, b = fingerprints.sketch_many([text, fingerprints.edited(text, prose(9, 6000))])
        assert fingerprints.likeness(a, b) > 0.5


def test_fingerprints_of_short_texts_survive_an_edit():
    sketch = lambda t: fingerprints.unpack(fingerprints.pack(fingerprints.sketch_many([t])[0]))
    for n in range(7, 300):
        for text, following in ((prose(n, 60)[:n], prose(1000 + n, 60)), (prose(n, 60)[:n], "é😀" * 200), (prose(n, 60)[: n - n // 4] + "😀" * (n // 4), "x" * 300)):
            changed = fingerprints.edited(text, following)
            assert fingerprints.likeness(sketch(text), sketch(changed)) > 0 and fingerprints.likeness(sketch(text), sketch(text)) == 1.0
    assert fingerprints.likeness(sketch("short"), sketch(prose(1, 60))) == 0.0 and sketch(prose(1, 60))[0][-1] < fingerprints.SHORT_BIT


def test_syncmers_equal_their_definition():
    raw = prose(1, 60).encode()
    data = np.frombuffer(raw, np.uint8)
    pos, _ = fingerprints.syncmers(data, np.array([0, 100, len(raw)]))
    inner = fingerprints.mix(fingerprints.eights(data)[: len(raw) - 7])
    want = []
    for i in range(len(raw) - fingerprints.K + 1):
        if i < 100 < i + fingerprints.K:
            continue
        s = inner[i : i + fingerprints.K - fingerprints.S + 1]
        if s.min() in (s[0], s[-1]):
            want.append(i)
    assert pos.tolist() == want


def test_text_primitives():
    data, off = utf8_buffer(pa.array(["ab c", None, "é-d"]))
    s, e, d = words(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["ab", "c", "é", "d"] and d.tolist() == [0, 0, 2, 2]
    batch = pa.RecordBatch.from_pydict({"text": ["aaaa", "b", None, "cccccc"]})
    assert [p.num_rows for p in pieces([batch], limit=5)] == [3, 1]


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    extra = spark.createDataFrame([(10**6, "12 34 %%", "en", "s", 8), (10**6 + 1, None, None, None, None)], SCHEMA)
    docs = docs.select([c.split()[0] for c in SCHEMA.split(", ")]).union(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
        kept = corpus_pipeline.workspace.written(stage(spark, kept, sf), name)
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        if name == "language_id":
            assert set(ids) == set(before) - {10**6, 10**6 + 1}
        if name == "exact_dedup":
            groups = {}
            for i, t in before.items():
                k = re.sub(r"[\x20\x09-\x0D]", "", t)
                groups[k] = min(groups.get(k, (1, 1)), (-len(t), i))
            assert sorted(ids) == sorted(i for _, i in groups.values())
        if name == "near_dedup":
            order = sorted(before)
            classes = brute_classes(order, [before[i] for i in order])
            assert sorted(ids) == sorted(i for i, c in classes.items() if i == c)
        if name == "mixing":
            assert set(ids) <= set(before) and len(set(ids)) > 0.8 * len(before)
        if name == "byte_bpe":
            assert all(r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest() for r in kept.collect())


def test_pipeline_on_repeated_rows_clashing_names_and_empty_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select([c.split()[0] for c in SCHEMA.split(", ")]).limit(60)
    docs = docs.union(docs.limit(20)).union(spark.createDataFrame([(None, "a text of its own without a number of its own", "en", None, None), (None, None, None, None, None)], SCHEMA))
    names = ["_gone", "_row", "_id", "_digest", "_posterior", "score", "n_tokens", "rejected", "kept", "class_id", "content", "lang_pred"]
    wide = docs.withColumns({c: F.lit(k) for k, c in enumerate(names)})

    def through(d, stages):
        for name, stage in stages:
            d = corpus_pipeline.workspace.written(stage(spark, d, sf), name)
        return d

    kept = through(wide, corpus_pipeline.STAGES[:-1])
    assert kept.columns == wide.columns and all(r[c] == k for r in kept.collect() for k, c in enumerate(names))
    plain, whole = through(docs, corpus_pipeline.STAGES), through(wide, corpus_pipeline.STAGES)
    row = lambda r: (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
    assert sorted(map(row, plain.collect()), key=str) == sorted(map(row, whole.collect()), key=str)
    assert through(docs.limit(0), corpus_pipeline.STAGES).count() == 0
