"""Cap filters, cross-tokenizer alignment and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from broadsheet.llm import alignment, byte_bpe, cap_filters, prefix_trie, queries

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# operator 11


def brute_links(vectors, limit=0.9):
    """n_links and the least id reachable of each (id, vector), by comparing all pairs."""
    n = len(vectors)
    unit = []
    for _, v in vectors:
        x = np.array([np.nan if e is None else e for e in v], np.float64) if v else np.zeros(0)
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if len(x) and np.isfinite(x).all() and x.any() else None)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [vectors[j][0] for j in seen if vectors[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vectors[i][0], len(near[i]), least, least is not None and vectors[i][0] == least))
    return sorted(out, key=repr)


def clustered(rng, dims, groups, size, noise):
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            step = rng.standard_normal(dims)
            out.append((centre + noise * rng.random() * step / np.linalg.norm(step)).astype(np.float32))
    return out


def test_cap_filters_find_all_links_of_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_links([(r.vec_id, list(r.embedding)) for r in table.collect()])
    assert rows_of(queries.queries()["op11_cap_filters"](spark, sf_dir), "vec_id", "n_links", "component_id", "kept") == want


def test_cap_filters_on_groups_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", 16)
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 24, 12, 30, 0.6) + clustered(rng, 24, 1, 90, 0.3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(5, rows[5][1]), (None, rows[7][1]), (None, [0.0] * 24), (2000, None), (2001, []), (2002, [0.0] * 24), (2003, [None] * 24), (2004, [float("nan")] * 24)]
    rows += [(2005, [float("inf")] + [1.0] * 23), (2006, [1.0]), (2007, [2.0]), (2008, [-1.0]), (2009, [1e-30] * 24), (2010, [3e37] * 24), (2011, [1.0, 2.0]), (2011, [1.0, 2.1]), (2012, [2.0, -1.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, key string, links int")
    want = brute_links([(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows])
    got = rows_of(cap_filters.near_duplicates(table), "vec_id", "n_links", "component_id", "kept")
    assert got == want
    doubles = table.selectExpr("vec_id", "cast(embedding as array<double>) embedding")
    assert rows_of(cap_filters.near_duplicates(doubles), "vec_id", "n_links", "component_id", "kept") == want
    assert cap_filters.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("count", [2_000, 50_000, 5_000_000])
def test_pairs_at_the_limit_share_a_filter(count):
    """Pairs at a cosine of 0.9 exactly, the hardest there are; filters stay as many as the formula says."""
    rng, n, dims = np.random.default_rng(9), 4_000, 64
    a, step = rng.standard_normal((n, dims)), rng.standard_normal((n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    step -= (step * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * step / np.linalg.norm(step, axis=1, keepdims=True)
    code = cap_filters.ProductCode(dims, count, 0.9)
    found = []
    for x in (a, b):
        row, number = code.filters(x)
        of = defaultdict(set)
        for r, f in zip(row.tolist(), number.tolist(), strict=True):
            of[r].add(f)
        found.append(of)
    assert sum(not found[0][i] & found[1][i] for i in range(n)) <= n // 250
    assert sum(map(len, found[0].values())) / n < 120


def test_decoding_lists_exactly_the_filters_exceeded():
    code = cap_filters.ProductCode(40, 3_000, 0.9)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = set(zip(*(v.tolist() for v in code.filters(x)), strict=True))
    want = set()
    for k, (rotation, blocks) in enumerate(zip(code.rotations, code.code, strict=True)):
        all_of = np.zeros((20, 1))
        for own, c in zip(code.cut, blocks, strict=True):
            all_of = (all_of[:, :, None] + ((x @ rotation)[:, own] @ c.T)[:, None, :]).reshape(20, -1)
        i, j = np.nonzero(all_of >= code.height)
        want |= set(zip(i.tolist(), (k * code.words**code.blocks + j).tolist(), strict=True))
    assert got == want and want


# operator 12


def token_bytes():
    of_char = {c: b for b, c in enumerate(byte_bpe.byte_chars())}
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    entry = lambda i: bytes(of_char[c] for c in a.id_to_token(i))
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return (lambda t: [(i, entry(i)) for i in a.encode(" " + t, add_special_tokens=False).ids]), (lambda t: [(i, piece(b.id_to_piece(i))) for i in b.encode(t)])


def brute_alignment(docs):
    of_a, of_b = token_bytes()
    linked, rows = [], []
    for i, text in docs:
        a, b = (of_a(text), of_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for token, raw in side:
                out.append((token, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if s < v and u < e]
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(t) for t, s, e in side if low <= s and e <= high) for side in spans))
            low = high
        rows.append([i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
        linked.append(set(links))
    count = Counter(p for s in linked for p in s)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted(((i, n, m, g, len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), h) for i, n, m, g, ls, h in rows), key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  a", "a ", "a  b", "a\n b\n\n", "x<|endoftext|>y", "<s> </s> <unk> <0x41>", "a▁b", "a" * 900, "don't I'll HE'S 1234567", "\x1c a\x1d\x85 b", "　 x  y", "😀😀 é́ Σας ΑΣ", "\x00 \x01", "the same", "the same",
    "ﬁ ½ Å", "\t\tx\r\n", "日本語の文章", "word " * 400,
]


@pytest.mark.parametrize("piece", [1_000_000, 40])
def test_alignment(spark, sf_dir, monkeypatch, piece):
    odd = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id at all")]
    table = spark.createDataFrame([(i, t, 7, "x") for i, t in odd], "doc_id long, text string, batch int, n_a string").coalesce(2)
    if piece == 40:  # long texts in stretches, several batches
        aligner = alignment.Aligner(BYTE, PIECE)
        whole = aligner.align([t for _, t in odd])
        monkeypatch.setattr(alignment, "SLICE", piece)
        cut = aligner.align([t for _, t in odd])
        assert all(list(map(list, whole[0][c])) == list(map(list, cut[0][c])) for c in ("steps", "times")) and all((np.asarray(whole[0][c]) == np.asarray(cut[0][c])).all() for c in ("n_groups", "groups_sha256", "n_links"))
        return
    assert rows_of(alignment.alignment(table, BYTE, PIECE), *ALIGNED) == brute_alignment(odd)
    assert alignment.alignment(table.limit(0), BYTE, PIECE).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000")
    want = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(alignment.alignment(docs.repartition(5), BYTE, PIECE), *ALIGNED) == want


# operator 13


def brute_trie(turns, every=100, parts=6):
    by = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest(), (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in by.items()}
    built = {c: own.get(c - int(np.fmod(c, every)), [])[: (h := zlib.crc32(str(c).encode()) % parts)] + own[c][h:] for c in own}
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
            if d:
                children[tuple(seq[: d - 1])].add(tuple(seq[:d]))
        ends[tuple(seq)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in list(members.items())), key=repr
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made_turns(rng, convs, words):
    out = []
    for c in convs:
        for k in range(rng.randint(1, 9)):
            out.append((c, k if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]), rng.choice(words)))
    return out


@pytest.mark.parametrize("local", [200, 3])
def test_prefix_trie(spark, sf_dir, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "LOCAL", local)
    monkeypatch.setattr(prefix_trie, "AHEAD", 4)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert rows_of(queries.queries()["op13_prefix_trie"](spark, sf_dir), *TRIE) == want
    rng = random.Random(4)
    turns = made_turns(rng, [*range(-30, 60), 100, 101, 205, 206, 299], ["", "é", "bb", None, "x" * 50])
    same = [(c, k, "user", "hello") for c in range(300, 420) for k in range(12)] + [(500, k, "user", "hello") for k in range(7)]
    odd = [*turns, *turns[:5], *same, (None, 1, "user", "no conversation")]
    table = spark.createDataFrame([(*r, 1, "y") for r in odd], "conv_id long, turn int, role string, text string, n int, depth string")
    assert rows_of(prefix_trie.prefix_trie(table), *TRIE) == brute_trie(odd)
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0


def test_prefix_trie_sql(sf_dir):
    db = duckdb.connect()
    rng = random.Random(8)
    odd = made_turns(rng, [*range(-20, 40), 100, 101, 205], ["", "é", None, "abc"])
    db.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", odd)
    got = db.sql(queries.oracle_sql()["op13_prefix_trie"]).project(", ".join(TRIE)).fetchall()
    assert sorted(got, key=repr) == brute_trie(odd)
