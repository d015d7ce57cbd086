"""The ten corpus operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from broadsheet.llm import bpe_codec, common, components, decontaminate, lines, near_copies, queries, repeats, rules, sharding, simhash, token_counts, token_files, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  a", "a ", "a  b", "a\n b", "\n\n", "x<|endoftext|>y", "<|endoftext|> <|startoftext|>", "a" * 3000, "don't I'll HE'S", "\x1c a\x1d\x85 b", "　 x  y", "😀😀 é́ Σας ΑΣ",
    "The same line. The same line.\nThe same line.", "The same line. The same line.\nThe same line.", "ab " * 3000, "x" * 199, "x" * 200, "word " * 25 + "$$$ ###", "tab\tand\x0bvt\x0cff\rcr",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, twice the same row, a null id, and columns whose names clash with the operators' own."""
    rows = [(i, t, f"src{i % 3}" if i % 5 else None, 1, "x") for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "no id at all", "src1", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, n_words string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def texts_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_bpe_matches_the_library(docs, odd, empty):
    hf = Tokenizer.from_file(BYTE)
    for table in (docs, odd):
        want = []
        for i, t in texts_of(table):
            ids = hf.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(hf.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert rows_of(bpe_codec.encode_digests(table, BYTE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe_codec.encode_digests(empty, BYTE).count() == 0
    back = odd.where("text is not null").withColumn("ids", bpe_codec.encode_column(F.col("text"), BYTE)).withColumn("back", bpe_codec.decode_column(F.col("ids"), BYTE))
    assert back.where("back <> text").count() == 0


def test_backtracking_on_random_strings():
    encoder = bpe_codec._codec(BYTE)[0]
    hf, rng = Tokenizer.from_file(BYTE), random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice("abethin stron \n'123é-.😀") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == hf.encode(t, add_special_tokens=False).ids


def test_token_counts(docs, odd, empty):
    hf = Tokenizer.from_file(BYTE)
    for table in (docs, odd):
        want = [(i, len((t or "").encode()), n := len(hf.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in texts_of(table)]
        assert rows_of(token_counts.token_counts(table, BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_token_files_round_trip(spark, docs, odd, empty, tmp_path):
    hf = Tokenizer.from_file(WORD)
    for table in (docs, odd):
        want, start = [], 0
        for i, t in sorted(texts_of(table), key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = np.array([*hf.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert rows_of(token_files.token_file_digests(table, WORD), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_files.token_file_digests(empty, WORD).count() == 0
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (rng.random(n) ** 8 * 2**32).astype(np.uint32)
        cuts = np.diff(np.sort(np.concatenate([[0, n], rng.integers(0, n + 1, 5)])))  # several documents, empty ones too
        assert (token_files.unpack(*token_files.pack(r, cuts), cuts) == r).all()


def test_runs_are_cut_as_the_library_has_it():
    hf, own, rng = Tokenizer.from_file(WORD), token_files._runs(WORD), random.Random(4)
    letters = ["e", "E", "é", "É", "ß", "ſ", "K", "H\u0331", "e\u0301", ">\u0338", "İ", "Σ", "'s", "'S", "'ll", "n't", "3", "²", "½", "٣", "_", ".", ",", "...", "-", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "中", "😀", "\x1c", "\u3000", " ", "\n", "µ", "ª", "ÿ", "Ÿ", "ǅ", "ﬁ"]
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(own.encode(t), own.dtype).tolist() == hf.encode(t, add_special_tokens=False).ids, t


def test_shards(docs, odd, empty):
    for table, n in ((docs, 8), (odd, 3)):
        got = sharding.shard_documents(table, n).toPandas()
        text = {}
        for i, t in texts_of(table):
            text.setdefault(i if i is not None else -1, t or "")
        got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
        assert len(got) == table.count() and set(got["shard"]) <= set(range(n)) and set(got["law"]) == {"bytes"}
        assert all(got["size"] == [len(text[i].encode()) + 1 for i in got["doc_id"]])
        assert all(got["text_crc32"] == [zlib.crc32(text[i].encode()) for i in got["doc_id"]])
        assert got.assign(t=[text[i] for i in got["doc_id"]]).groupby("t")["shard"].nunique().max() == 1
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
    sums = sharding.shard_documents(docs, 4).toPandas().groupby("shard")["size"].sum()
    assert sharding.spread(list(sums)) < 0.01
    assert sharding.shard_documents(empty, 4).count() == 0


def test_sharding_in_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_IN", 8)
    rng = random.Random(2)
    groups = spark.createDataFrame([(k, rng.randint(1, 10_000)) for k in range(700)], "group long, bytes long")
    got = sharding.group_shards(groups, 700, 5).join(groups, "group").toPandas()
    assert len(got) == 700 and got["group"].is_unique
    sums = got.groupby("shard")["bytes"].sum()
    assert len(sums) == 5 and sharding.spread(list(sums)) < 0.001


def test_differencing_is_exact_on_small_numbers():
    out = sharding.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    sums = np.zeros(2, int)
    for row, to in zip([8, 7, 6, 5, 4], out[:, 0], strict=True):
        sums[to] += row
    assert sorted(sums) == [14, 16]  # the well-known outcome of the differencing method


def brute_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_rules(spark, docs, odd, empty, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for table in (docs, odd):
        want = []
        for i, t in texts_of(table):
            b = brute_rules(t)
            want.append((i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
        out = rules.quality_rules(table, labels)
        assert rows_of(out, *names) == sorted(want, key=repr)
        assert out.where("base_failed and kept").count() == 0
    assert rules.quality_rules(empty, labels).count() == 0
    assert rules.quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_quality_on_held_out_labels(spark):
    """Learnt from two thirds of the labels, judged on the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = rules.quality_rules(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").select("kept", "quality").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.kept.mean() > 0.93 and (~bad.kept).mean() > 0.6


def test_toxicity_on_held_out_labels(spark, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id])
    j = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert ((j.predicted == 1) & (j.toxic == 0)).sum() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0 or predicted <> 0").count() == 0


def test_toxicity_catches_and_spares(spark):
    """Held-out recall and false alarms on the largest table, every language; about one toxic label in fifteen is noise."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    out = toxicity.toxicity(docs, labels).where("held_out").toPandas().merge(labels.toPandas(), on="doc_id").merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert toxic.predicted.mean() > 0.85 and clean.predicted.mean() < 0.01
    assert (toxic.groupby("lang").predicted.mean() > 0.6).all()


def test_toxic_segments(spark):
    """The passage that tells is found where it stands."""
    rows = [(i, "good words stand here " * 3 + ("vile foul rotten " if i % 3 == 0 else "") + "and good words behind", int(i % 3 == 0)) for i in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = toxicity.toxic_segments(docs, toxicity.fit(docs, labels)).toPandas()
    assert set(found.doc_id) == {r[0] for r in rows if r[2]} and set(zip(found["first"], found["end"], strict=True)) == {(12, 15)}


def test_repeated_passages_are_all_found(spark):
    rows = [(i, "good words stand here " * 3 + ("vile foul rotten " if i % 3 == 0 else "") + "and good words behind", int(i % 3 == 0)) for i in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    twice = "good words stand here " * 3 + "vile foul rotten " + "good words stand here " * 200 + "vile foul rotten " + "and good words behind"
    found = toxicity.toxic_segments(spark.createDataFrame([(1, twice), (2, None), (3, "")], "doc_id long, text string"), toxicity.fit(docs, labels)).toPandas()
    assert sorted(zip(found["doc_id"], found["first"], found["end"], strict=True)) == [(1, 12, 15), (1, 815, 818)]


def test_toxicity_of_odd_texts(spark, odd, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))] + [(3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd, labels).toPandas()
    assert len(out) == len(ODD) + 2 and out.score.between(0, 1).all()
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns


def brute_segments(s):
    """Maximal scoring segments by their definition: the best one, then those of what is left on both sides."""
    best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0, 0, 0))
    if best[0] <= 0:
        return []
    # the longest of the best would join zero-scored ends; scores here make sums unique
    i, j = best[3], best[4]
    return brute_segments(s[:i]) + [(i, j, best[0])] + [(a + j, b + j, x) for a, b, x in brute_segments(s[j:])]


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-1, -0.5, 2, 1]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        before = np.concatenate([[0.0], np.cumsum(s)])
        got = toxicity.maximal_segments(s, [i for i, x in enumerate(s) if x > 0], before)
        assert [(a, b) for a, b, _ in sorted(got)] == [(a, b) for a, b, _ in brute_segments(s)]


def brute_print(t, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_simhash(pairs):
    prints = [brute_print(t) for _, t in pairs]
    ids = list(range(len(pairs)))
    root = brute_components(ids, [(i, j) for i in ids for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for i in ids:
        if pairs[i][0] is not None:
            least[root[i]] = min(least.get(root[i], 1 << 60), pairs[i][0])
    return sorted(((pairs[i][0], f"{prints[i]:016x}", least.get(root[i])) for i in ids), key=repr)


def test_simhash(docs, odd, empty):
    for table in (docs, odd):
        assert rows_of(simhash.near_duplicates(table), "doc_id", "fingerprint", "component_id") == brute_simhash(texts_of(table))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("words", "segments", "most", "hot"), [(1, 4, 3, 20_000), (1, 4, 3, 4), (2, 16, 15, 20_000), (2, 16, 15, 6), (1, 4, 1, 20_000)])
def test_links_join_what_is_near(spark, words, segments, most, hot):
    """Clusters around random centres, hot keys included: the components are those of all close pairs."""
    rng, n_bits = random.Random(words * 100 + most + hot), 64 * words
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(n_bits)
        for _ in range(rng.choice([1, 3, 25])):
            x = centre
            for b in rng.sample(range(n_bits), rng.randint(0, most + 2)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    prints = spark.createDataFrame([(f"{v:0{16 * words}x}",) for v in values], "fp string")
    links = simhash.fingerprint_links(prints, simhash.Ring(words, segments, most), hot)
    got = {r[0]: r[1] for r in components.components(links).collect()}
    want = brute_components(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= most])
    assert {v: int(got.get(f"{v:0{16 * words}x}", f"{v:x}"), 16) for v in values} == want


def test_one_of_each(spark, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    got = [r[0] for r in kept.select("doc_id").collect()]
    assert len(got) == len(set(got)) and 15 in got and 16 not in got and 0 in got and 1 not in got


def brute_copies(pairs, width=5):
    """The least id of each document's component under exact Jaccard similarity of shingle sets; ids are distinct."""
    sets = {}
    for i, t in pairs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(" ".join(words[k : k + width]) for k in range(len(words) - width + 1)) or frozenset([" ".join(words)] if words else [])
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    ids = sorted(sets)
    return brute_components(ids, [(i, j) for i in ids for j in ids if j < i and alike(sets[i], sets[j])])


@pytest.fixture(scope="module")
def edited(spark):
    """Texts with copies of which words were replaced, so that the similarities lie on both sides of 0.8; one group is large."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " ", "a b", "A  b"]
    for n, copies in [(8, 3), (20, 4), (60, 6), (200, 6), (200, 6), (400, 6), (90, 80)]:
        first = [word() for _ in range(n)]
        texts.append(" ".join(first))
        for k in range(copies):
            own = list(first)
            for at in rng.sample(range(n), max(1, n * (k % 6) // 200)):
                own[at] = word()
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("many", [near_copies.MANY, 0])
def test_one_of_each_against_jaccard(spark, edited, docs, many, monkeypatch):
    monkeypatch.setattr(near_copies, "MANY", many)
    for table in (edited, docs.select("doc_id", "text")):
        want = brute_copies(texts_of(table))
        assert {r[0]: r[1] for r in near_copies.near_copies(table).collect()} == want
        assert sorted(r[0] for r in simhash.one_of_each(table).select("doc_id").collect()) == sorted(set(want.values()))


def test_edited_copies_of_one_text_meet_by_sketch_only(spark, monkeypatch):
    """A thousand texts that all share most of their shingles, few of them similar: their whole sets hardly ever meet."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(250)]
    rows = []
    for i in range(1000):
        words = list(base)
        for at in rng.sample(range(5, 245), 4):
            words[at] = f"x{i}.{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000, rows[7][1].replace(base[0], "other", 1)), (1001, rows[8][1])]
    met, confirm = [], near_copies.confirmed

    def counted(pairs, sets):
        met.append(pairs.count())
        return confirm(pairs, sets)

    monkeypatch.setattr(near_copies, "confirmed", counted)
    monkeypatch.setattr(near_copies, "BLOCK", 300)
    got = {r[0]: r[1] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(met) < 10 * len(rows)
    assert got == brute_copies(rows)


def test_wide_prints_count_bits():
    rng = np.random.default_rng(7)
    for n in (1, 4, 14, 15, 16, 40, 41, 255, 256, 700):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        words = simhash.wide_print(a)
        assert len(words) == simhash.RING_WORDS * (2 if n <= simhash.FEW else 1)
        for k in (0, 3, len(words) - 1):
            own = simhash.mixed(a + np.uint64(k + 1) * simhash._MIX[0])
            assert int(words[k]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in own) > len(a))


def test_near_copies_meet_by_simhash(spark, monkeypatch):
    """Pairs at a similarity of 0.8 (or hardly more), the hardest: the segments of their SimHashes find all, and hardly any pair that is not one."""
    rng = np.random.default_rng(8)
    sets = []
    for n in (4, 8, 20, 36, 40, 80, 200, 400):
        for _ in range(100):
            every = np.unique(rng.integers(0, 1 << 64, n + n // 4, dtype=np.uint64))
            cut = len(every) // 10  # common 8 of 10 shingles
            sets += [every[: len(every) - cut], every[cut:]] if len(every) >= 10 else [every, every[:-1]]
    ids = [int.from_bytes(bytes.fromhex(near_copies.set_id(x)[:16]), "little", signed=True) for x in sets]
    prints = spark.createDataFrame([(i, bytearray(simhash.wide_print(x).tobytes())) for i, x in zip(ids, sets, strict=True)], "sid long, print binary")
    met: dict[int, set[int]] = {}
    for key, i in simhash.segment_clusters(prints).collect():
        met.setdefault(key, set()).add(i)
    pairs = {(a, b) for own in met.values() for a in own for b in own if a != b}
    assert all(p in pairs for p in zip(ids[::2], ids[1::2], strict=True))
    assert len(pairs) < 2.1 * len(ids)
    asked = []
    monkeypatch.setattr(near_copies, "segment_clusters", lambda x: asked.append(1) or simhash.segment_clusters(x))
    text = " ".join(f"w{i}" for i in range(100))
    table = spark.createDataFrame([(0, text), (1, text.replace("w50", "other"))], "doc_id long, text string")
    assert [r[0] for r in simhash.one_of_each(table).select("doc_id").collect()] == [0] and asked


def test_pairs_of_edited_copies_leave_their_clusters_once(spark):
    """Edited copies of one text share many segments of their SimHashes: a pair that may be similar is listed for one of them, and none is lost."""
    rng = random.Random(9)
    sets = {}
    for words in (200, 30):  # 30: sets of two rings
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for i in range(250):
            own = list(base)
            for at in rng.sample(range(words), 1 + words // 70):
                own[at] = f"x{i}.{at}"
            s = near_copies.shingle_set(" ".join(own), 5)
            sets[int.from_bytes(bytes.fromhex(near_copies.set_id(s)[:16]), "little", signed=True)] = s
    prints = {i: simhash.wide_print(s).astype("<u8").tobytes() for i, s in sets.items()}
    met = simhash.segment_clusters(spark.createDataFrame([(i, bytearray(x)) for i, x in prints.items()], "sid long, print binary")).select("key.*", "sid").toPandas()
    assert (met["n"] == met.groupby("key")["sid"].transform("size")).all() and not met.duplicated(["key", "sid"]).any()
    rows = pd.DataFrame({"key": met["key"], "low": 0, "high": 0, "block": 0, "place": met["place"], "set_id": met["sid"].map(str), "comp": met["sid"].map(str), "shared": 1 << 30})
    rows["size"] = met["sid"].map(lambda i: len(sets[i]))
    rows["sketch"] = met["sid"].map(lambda i: near_copies.odd_sketch(sets[i]))
    rows["first"] = [prints[i][: 2 * p + 8] for i, p in zip(met["sid"], met["place"], strict=True)]
    rows = rows.sort_values(near_copies.DEALT, kind="stable", ignore_index=True)
    got = pd.concat(list(near_copies.near_pairs(rows.iloc[at : at + 1000] for at in range(0, len(rows), 1000))))
    together = {tuple(sorted((a, b))) for own in rows.groupby("key")["set_id"].agg(list) for a in own for b in own if a != b}
    one = rows.drop_duplicates("set_id").set_index("set_id")

    def may(a, b):
        x, y = (one.at[i, "sketch"].view(np.uint64)[None] for i in (a, b))
        few, p, q = min(x.shape[1], y.shape[1]), one.at[a, "size"], one.at[b, "size"]
        return 5 * min(p, q) >= 4 * max(p, q) and 9 * int(np.bitwise_count(near_copies.folded(x, few) ^ near_copies.folded(y, few)).sum()) <= p + q

    want = {p for p in together if may(*p)}
    assert set(zip(got["a"], got["b"], strict=True)) == want and len(want) > 500
    assert len(got) < 1.1 * len(want)  # before, once for each segment that both share


def test_line_dedup_writes_no_plan_that_turns_with_size(spark):
    """Texts meet the keys of their lines by the same join whatever the size, so what is shuffled grows with the table."""
    rows = [(i, f"s{i}", f"every\nown {i}") for i in range(30)]
    out = lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert sorted(r[2] for r in out.collect()) == sorted(["every\nown 0"] + [f"own {i}" for i in range(1, 30)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_contexts_are_cut_many_texts_at_once():
    n = 500
    texts = [f"{i:04d}" * 100 for i in range(n)]
    each = {c: [np.array([k + i, k], np.int64) for i in range(n)] for k, c in enumerate(("a", "m", "lo", "len", "p"), 1)}
    frames = list(repeats.cut_contexts(iter([pd.DataFrame({"th": np.arange(n), "nb": 400, "text": texts} | each)])))
    assert len(frames) == 1  # before, a frame for each text
    got = frames[0]
    assert got["bytes"].tolist() == [texts[i].encode()[lo : lo + size] for i in range(n) for lo, size in zip(each["lo"][i], each["len"][i], strict=True)]
    assert got["a"].tolist() == [x for y in each["a"] for x in y] and got["th"].tolist() == [i for i in range(n) for _ in range(2)]


def test_odd_sketches_never_overstate():
    rng = np.random.default_rng(2)
    for n in (0, 1, 20, 300, 5000):
        a = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        b = np.unique(np.append(a[: n // 2], rng.integers(0, 1 << 62, n // 3 + 1, dtype=np.uint64)))
        x, y = near_copies.odd_sketch(np.unique(a)).view(np.uint64)[None], near_copies.odd_sketch(b).view(np.uint64)[None]
        few = min(x.shape[1], y.shape[1])
        far = int(np.bitwise_count(near_copies.folded(x, few) ^ near_copies.folded(y, few)).sum())
        assert far <= len(set(a.tolist()) ^ set(b.tolist()))
        assert (near_copies.folded(near_copies.odd_sketch(b).view(np.uint64)[None], 2) == near_copies.folded(y, 2)).all()


def test_written_shards_hold_each_row_once(spark, odd, tmp_path):
    table = odd.unionByName(odd.where("doc_id = 3")).withColumn("_shard", F.lit("own")).withColumn("_group", F.lit(1))
    sharding.write_shards(table, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert rows_of(back.select(*table.columns), *table.columns) == rows_of(table, *table.columns)
    assert back.groupBy("text").agg(F.count_distinct("_shard_").alias("n")).where("n > 1").count() == 0


def test_stages_on_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id string, text string")
    for out in (simhash.one_of_each(empty), lines.without_boilerplate(empty), toxicity.without_toxic(empty, labels), decontaminate.decontaminate(empty, items)):
        assert out.columns == empty.columns and out.count() == 0


def test_pipeline_run_leaves_no_tables_behind(spark, sf_dir, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{t}.parquet")
    monkeypatch.setitem(common._own_dir, "dir", f"file://{tmp_path}/shared")
    out = pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if not spark.conf.get("spark.checkpoint.dir", None):
        assert [p.name.split("-")[1] for p in (tmp_path / "shared").iterdir() if p.is_dir()] == ["after_decontaminate"]
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_components_of_chains(spark):
    links = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("900", "901"), ("901", "900"), ("902", "902"), (None, "1")]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert len(got) == 63 and {v for k, v in got.items() if k < "900"} == {"000"} and got["901"] == "900"


def brute_lines(rows, least):
    bare = lambda x: re.sub(r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "", x)
    sites, keeper = defaultdict(set), {}
    for i, t, s in rows:
        for line in (t.split("\n") if t is not None else []):
            if b := bare(line):
                sites[b].add(s)
                if i is not None:
                    keeper[b] = min(keeper.get(b, i), i)
    out = []
    for i, t, _ in rows:
        all_ = t.split("\n") if t is not None else []
        kept = [x for x in all_ if not bare(x) or len(sites[bare(x)]) < least or (i is not None and keeper.get(bare(x)) == i)]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 3, 10])
def test_line_dedup(docs, odd, empty, least):
    for table in (docs, odd):
        rows = [tuple(r) for r in table.select("doc_id", "text", "source").collect()]
        assert rows_of(lines.line_dedup(table, least), "doc_id", "n_lines", "n_removed", "kept_sha256") == brute_lines(rows, least)
    assert lines.line_dedup(empty, least).count() == 0
    assert lines.without_boilerplate(odd, least).columns == odd.columns


def repeated_brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        rest = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "k", "limits"), [(200, 32, {}), (40, 12, {}), (40, 12, {"block_bytes": 500, "hot_bytes": 300})])
def test_repeats(docs, odd, empty, length, k, limits):
    for table in (docs, odd):
        pairs = texts_of(table)
        got = repeats.remove_repeats(table.select("doc_id", "text"), length, k, **limits).withColumn("h", F.sha2("kept", 256))
        want = sorted(((i, *x) for (i, _), x in zip(pairs, repeated_brute([t for _, t in pairs], length), strict=True)), key=repr)
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == want
    assert repeats.remove_repeats(empty, length, k).count() == 0


def test_suffixes_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        length, letters = rng.choice([2, 3, 5, 8, 20]), rng.choice(["ab", "abc", "abcdefgh"])
        strings = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        raw = np.frombuffer(b"".join(s.encode() + b"\0" for s in strings), np.uint8).astype(np.int64)
        starts, at = defaultdict(list), 0
        for s in strings:
            for i in range(len(s) - length + 1):
                starts[s[i : i + length]].append(at + i)
            at += len(s) + 1
        want = sorted(p for v in starts.values() if len(v) > 1 for p in v)
        assert repeats.repeated_suffixes(np.where(raw > 0, raw + 1, 0), length).tolist() == want


def brute_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wanted = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wanted[tuple(w[k : k + n])].add(str(i))
    sizes = {len(k) for k in wanted}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in wanted:
                    hit |= set(range(k, k + n))
                    found |= wanted[key]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, odd, empty, sf_dir, monkeypatch):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    small = spark.createDataFrame([(1, "same line"), (2, "A A"), (3, None), (4, ""), (5, "The same line the same line"), (5, "word " * 12), (6, "same LINE")], "item_id long, text string")
    for table, items in ((docs, bench), (odd, small), (docs, small)):
        want = brute_hits(texts_of(table), [tuple(r) for r in items.select("item_id", "text").collect()])
        assert rows_of(decontaminate.contamination(table, items), *columns) == want
    nameless = small.unionByName(spark.createDataFrame([(None, "same line"), (None, "nobody has this"), (None, "drops off and the line")], small.schema))
    named = lambda rows: [(*r[:3], *x[3:5], r[5]) for r, x in zip(rows, brute_hits(texts_of(odd), [tuple(r) for r in small.collect()]), strict=True)]
    want = named(brute_hits(texts_of(odd), [tuple(r) for r in nameless.collect()]))
    assert rows_of(decontaminate.contamination(odd, nameless), *columns) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    assert rows_of(decontaminate.contamination(odd, nameless), *columns) == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    clean = decontaminate.decontaminate(odd, small)
    assert clean.columns == odd.columns and clean.count() == sum(not r[5] for r in brute_hits(texts_of(odd), [tuple(r) for r in small.collect()]))


def test_longest_matches(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x a b c d e f y a b c"), (2, "q d e f g h"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h")], "item_id long, text string")
    got = rows_of(decontaminate.longest_matches(docs, bench, window=3), "doc_id", "item_id", "item_word", "doc_word", "n_words")
    assert got == [(1, "7", 0, 1, 6), (1, "7", 0, 8, 3), (2, "7", 3, 1, 5)]
    best = ["doc_id", "longest_words", "longest_item", "longest_at"]
    want = [(1, 6, "7", 1), (2, 5, "7", 1), (3, 0, None, None)]
    assert rows_of(decontaminate.contamination(docs, bench, window=3), *best) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30)
    two = bench.unionByName(spark.createDataFrame([(8, "a b c z z z z"), (9, "d e f")], bench.schema))
    assert rows_of(decontaminate.contamination(docs, two, window=3), *best) == want
    assert rows_of(decontaminate.longest_matches(docs, two, window=3), "doc_id", "item_id", "item_word", "doc_word", "n_words") == sorted([*got, (1, "8", 0, 1, 3), (1, "8", 0, 8, 3), (1, "9", 0, 4, 3), (2, "9", 0, 1, 3)], key=repr)


def test_longest_matches_against_brute_force(monkeypatch):
    """Diagonal by diagonal, whatever the number of pairs that are joined at once."""
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    rng = random.Random(8)
    for _ in range(60):
        text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        items, docs, w = [(f"i{k}", text()) for k in range(4)], [text() for _ in range(4)], 3
        want = []
        for d, t in enumerate(docs):
            for name, item in items:
                a, b = item.split(), t.split()
                n = min(w, len(a))
                same = lambda x, y: n and len(a) - x >= n and len(b) - y >= n and a[x : x + n] == b[y : y + n]
                for x in range(len(a)):
                    for y in range(len(b)):
                        if same(x, y) and not (x and y and same(x - 1, y - 1)):
                            m = 0
                            while x + m < len(a) and y + m < len(b) and same(x + m, y + m):
                                m += 1
                            want.append((d, name, x, y, m + n - 1))
        assert sorted(decontaminate.Benchmark(items, w).longest(docs)) == sorted(want)


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    """Every stage on all that the one before kept, against brute force; odd, null, repeated and extra columns go through."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("_score", F.lit("clash"))
    odd = spark.createDataFrame([(10_000 + k, t, "en", f"src{k % 3}" if k % 5 else None, 1, "x") for k, t in enumerate(ODD)] + [(10_004, ODD[4], "en", "src1", 1, "x")], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in now.select("doc_id", "text", "source").collect()]
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == now.columns
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            now = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            after = [tuple(r) for r in now.select("doc_id", "text", "source").collect()]
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
            assert sorted(after, key=repr) == sorted((r for r in before if not scores[r[0]]), key=repr)
        elif name == "line_dedup":
            sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
            assert sorted((i, sha(t)) for i, t, _ in after) == sorted((i, x) for i, _, _, x in brute_lines(before, lines.MIN_SITES))
        elif name == "simhash":
            assert sorted(r[0] for r in after) == sorted(set(brute_copies([r[:2] for r in before]).values()))
        elif name == "decontaminate":
            assert sorted(r[0] for r in after) == sorted(r[0] for r in brute_hits([r[:2] for r in before], bench) if not r[5])
        else:
            hf = Tokenizer.from_file(BYTE)
            assert rows_of(out, "doc_id", "n_tokens") == sorted(((i, len(hf.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in before), key=repr)


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
    assert json.dumps(sorted(names))
    assert pd.Series(names).is_unique
