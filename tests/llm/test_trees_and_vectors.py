"""SimHash components, Merkle manifests and whitening against plain versions, with nulls, ties, repeats and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from foreshock.llm import merkle, simhash, whitening
from foreshock.sources.tables import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id BIGINT, text STRING, source STRING, lang STRING, n_chars BIGINT, node BIGINT, tree STRING, fp INT"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- simhash ---------------------------------------------------------------------------------------------


def plain_print(text, n=3):
    w = WORD.findall(lower(text))
    runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Smallest reachable index for each fingerprint."""
    up = list(range(len(prints)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "one\n", "ONE two", "Ärger ÄRGER ärger", "a b c", "x " * 5000, "word" * 30000]
    base = [f"w{rng.randint(0, 300)}" for _ in range(200)]
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(200)] = f"z{rng.randint(0, 10**6)}"
        texts.append(" ".join(own).replace("w1", "W1"))
    texts += [" ".join(base)] * 4 + [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 60))) for _ in range(40)]
    sources = ["a", "b", None, "ä", "Z"]
    rows = [(7 * i % 211, t, sources[i % 5] if i % 2 else "a", None if i % 7 == 0 else "en", len(t or "") if i % 3 else None, i, "t", i) for i, t in enumerate(texts)]
    return rows + rows[12:16] + [(None, texts[20], "a", "en", 3, 0, "t", 0), (rows[3][0], "another text", rows[3][2], None, 1, 0, "t", 0)]


def test_simhash_is_the_plain_version(spark, corpus):
    out = simhash.simhash_components(spark.createDataFrame(corpus, DOCS).repartition(3))
    prints = [plain_print(r[1]) for r in corpus]
    comp = plain_components(prints)
    least = {}
    for row, c in zip(corpus, comp):
        if row[0] is not None:
            least[c] = min(least.get(c, row[0]), row[0])
    want = sorted((row[0] is not None, row[0] or 0, f"{p:016x}", least[c]) for row, p, c in zip(corpus, prints, comp))
    assert sorted((r[0] is not None, r[0] or 0, r[1], r[2]) for r in out.collect()) == want
    assert out.columns == ["doc_id", "fingerprint", "component_id"]


def test_simhash_of_very_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "_PIECE", 7)
    text = " ".join(f"w{i * i % 50}" for i in range(300))
    assert simhash.fingerprint(text.encode()) == plain_print(text)
    assert simhash.fingerprint(b"") == 0


@pytest.mark.parametrize("crowd", [2, 6, 1000])
def test_crowds_and_single_matches_give_the_same_links(spark, crowd):
    rng = random.Random(crowd)
    prints = set()
    for centre in (0, (1 << 64) - 1, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(60):  # dense balls, whose members share segments
            p = centre
            for _ in range(rng.randint(0, 6)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    for i in range(0, 30, 3):  # chains of three bits in either segment
        prints.add(int("1" * (i + 1), 2) ^ 0xABCDEF0123456789)
    prints |= {rng.getrandbits(64) for _ in range(60)}
    prints = sorted(prints)
    comp = plain_components(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    rows = cut_lineage(spark.createDataFrame([(signed(p),) for p in prints], "fp BIGINT"))
    found = {r["node"]: r["comp"] for r in simhash.linked(rows, crowd).collect()}
    groups, want = {}, {}
    for p, c in zip(prints, comp):
        groups.setdefault(found.get(signed(p), ("alone", p)), set()).add(p)
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(empty).collect() == []
    only = spark.createDataFrame([(None, None, None, None, None, 1, "", 1)], DOCS)
    assert [tuple(r) for r in simhash.simhash_components(only).collect()] == [(None, "0" * 16, None)]


# ---- merkle ----------------------------------------------------------------------------------------------


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_leaf(row, text):
    doc_id, _, source, lang, n_chars = row[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_steps(levels, i):
    for level in levels[:-1]:
        low = i - i % 16
        yield "".join(level[low:i]), "".join(level[i + 1 : low + 16])
        i //= 16


def plain_manifest(rows):
    trees, subroots, out = {}, [], []
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        own = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees[s] = own, plain_tree([plain_leaf(r, r[1]) for r in own])
        subroots.append(trees[s][1][-1][0])
    top = plain_tree(subroots)
    for t, s in enumerate(order):
        own, levels = trees[s]
        for i, r in enumerate(own):
            steps = [*plain_steps(levels, i), *plain_steps(top, t)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = plain_leaf(r, lower(r[1]) if hit and r[1] is not None else r[1])
            for left, right in steps:
                node = sha(left + node + right)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


TAMPERED = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0"


def test_manifest_is_the_plain_version(spark, corpus):
    out = merkle.verified(spark.createDataFrame(corpus, DOCS).repartition(3), TAMPERED)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == plain_manifest(corpus)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [256, 1, 2], [257, 40], [5000, 3], [2] * 300])
def test_manifest_of_trees_of_many_heights(spark, sizes):
    rows = [(i * 10 + k, f"Text {i} {k}", f"s{i:04}", "en", k) for i, n in enumerate(sizes) for k in range(n)]
    random.Random(1).shuffle(rows)
    out = merkle.verified(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, lang STRING, n_chars INT"), TAMPERED)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_manifest(rows)


def test_proofs_fold_to_the_root_and_middle_levels_are_not_stored(spark):
    rows = [(k, f"t{k}", "s", None, None) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, lang STRING, n_chars INT")
    m = merkle.manifest(docs)
    assert [level.count() for level in m.levels] == [700, 3, 1]  # the 44 nodes between are not there
    proofs = merkle.merkle_proofs(docs).collect()
    assert len(proofs) == 700
    for r in proofs:
        assert merkle.fold(r["leaf"], [merkle.Step(*s) for s in r["proof"]]) == m.root


def test_manifest_of_nothing(spark):
    assert merkle.verified(spark.createDataFrame([], DOCS), TAMPERED).collect() == []


def test_manifest_sql(spark, corpus):
    pdf = spark.createDataFrame(corpus, DOCS).toPandas()
    con = duckdb.connect()
    con.register("pdf", pdf)
    con.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source, lang, n_chars::BIGINT AS n_chars FROM pdf")
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    got = con.sql(f"SELECT {columns} FROM ({merkle.ORACLE_OP12})").fetchall()
    assert sorted(got, key=str) == plain_manifest(corpus)


# ---- whitening -------------------------------------------------------------------------------------------

VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, n INT, component STRING"


def plain_whitening(vectors, k=32):
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    centred = (n * x - s).astype(float) / n
    v = centred.T @ centred / n
    e, z = np.linalg.eigh(v)
    e, z = e[::-1][:k], z[:, ::-1][:, :k]
    return n, deviation, e / np.trace(v), centred @ z / np.sqrt(e)


def test_whitening_is_the_plain_version(spark):
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((300, 40)) * np.linspace(0.5, 3, 40)).astype(np.float32)
    rows = [(i % 290, [float(c) for c in v], 0, 0, "x") for i, v in enumerate(data)]
    rows += [(5, rows[5][1], 0, 0, "x"), (None, rows[6][1], 0, 0, "x")]
    kept = [r[1] for r in rows]
    bad = [None, [], [1.0] * 39, [1.0] * 39 + [None], [1.0] * 39 + [math.nan], [math.inf] + [1.0] * 39, [1e30] + [1.0] * 39]
    docs = spark.createDataFrame(rows + [(900 + i, v, 0, 0, "x") for i, v in enumerate(bad)], VECTORS).repartition(5)
    out = whitening.whitened(docs).toPandas()
    n, deviation, explained, w = plain_whitening(kept)
    assert len(out) == 302 * 32 and set(out["n"]) == {n} == {302}
    assert out["identity_error"].nunique() == 1 and out["identity_error"].max() < 1e-9
    signs = {}
    for i in (0, 1, 17, 250):
        own = out[out["vec_id"] == rows[i][0]]
        own = own[own["deviation"] == deviation[i]].drop_duplicates("component").sort_values("component")
        assert own["component"].tolist() == list(range(1, 33))
        assert np.allclose(own["explained"], explained, rtol=1e-9)
        ratio = own["whitened"].to_numpy() / w[i]
        assert np.allclose(np.abs(ratio), 1, atol=1e-7)
        signs.setdefault("first", np.sign(ratio))
        assert (np.sign(ratio) == signs["first"]).all()
    whole = sorted(deviation[i] for i in range(n) for _ in range(32))
    assert sorted(out["deviation"]) == whole


def test_whitening_of_few_and_equal_vectors(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame([(i, v, 0, 0, "x") for i, v in enumerate(rows)], VECTORS))
    assert make([]).collect() == []
    assert make([None, []]).collect() == []
    assert make([[1.0, 2.0]]).collect() == []
    assert make([[1.0, 2.0]] * 5).collect() == []
    line = make([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]]).collect()  # one direction only
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in line) == [(0, 1, 1.224744871), (1, 1, 0.0), (2, 1, 1.224744871)]
    assert all(r["explained"] == pytest.approx(1) and r["identity_error"] < 1e-9 for r in line)


def test_deviations_are_exact_and_null_beyond_a_long():
    x = np.array([[10**6, 10**6 + 1], [10**11, 3]])
    s = x.sum(axis=0)
    exact = [sum((2 * a - b) ** 2 for a, b in zip(row, s.tolist())) for row in x.tolist()]
    assert whitening.deviations(x, 2, s).to_pylist() == [e if e < 1 << 63 else None for e in exact]
    x = np.array([[3, 5], [4, 9], [1, 1]])
    assert whitening.deviations(x, 3, x.sum(axis=0)).to_pylist() == [1 + 0, 16 + 144, 25 + 144]


def hilbert(n):
    return 1 / (np.arange(n)[:, None] + np.arange(n)[None, :] + 1.0)


@pytest.mark.parametrize("kind", ["random", "identity", "threefold", "rank two", "graded", "glued"])
@pytest.mark.parametrize("d", [1, 2, 3, 21, 64])
def test_eigenvectors(kind, d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"threefold": np.arange(d) // 3 + 1.0, "graded": 10.0 ** -np.arange(d), "glued": 1 + np.arange(d) * 1e-9}.get(kind)
    v = np.eye(d) * 3 if kind == "identity" else rng.standard_normal((d, 2 if kind == "rank two" else d + 4))
    v = (q * values) @ q.T if values is not None else v @ v.T
    v = (v + v.T) / 2
    e, z = whitening.leading_components(v, 32)
    k = min(32, d)
    want = np.linalg.eigvalsh(v)[::-1][:k]
    assert np.allclose(e, want, atol=1e-13 * want[0], rtol=0)
    assert np.abs(z.T @ z - np.eye(k)).max() < 1e-12
    assert np.abs(v @ z - z * e).max() < 1e-13 * want[0] * d


def test_sturm_counts():
    rng = np.random.default_rng(1)
    diag, off = rng.standard_normal(30), rng.standard_normal(29)
    off[7] = 0.0
    values = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    at = rng.uniform(values[0] - 1, values[-1] + 1, 200)
    assert (whitening.sturm_counts(diag, off, at) == [(values < a).sum() for a in at]).all()
