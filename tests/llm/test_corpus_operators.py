"""Operators over whole corpora against brute force, on small fixtures with nulls, ties, repeats and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex

from foreshock.llm import chat, decontaminate, katz, mixing, near_dup
from foreshock.llm.components import contract
from foreshock.sources.tables import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id BIGINT, text STRING, source STRING, node BIGINT, rank STRING"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(rng, n, size=400):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, a family of near copies around a base, two chains, unrelated, short, empty and null texts."""
    rng = random.Random(11)
    texts = [None, "", " \n", "One", "one", "one two", "One  TWO", "one two three"]
    base = words(rng, 120)
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(120)] = f"z{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 5
    chain = words(rng, 150)
    for _ in range(6):
        texts.append(" ".join(chain))
        chain = chain[4:] + words(rng, 4)
    texts += [" ".join(words(rng, rng.randint(1, 80))) for _ in range(60)]
    return [(3 * i % 997, t, rng.choice(["a", "b", None]), i, "x") for i, t in enumerate(texts)]


def brute_components(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets.append(frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    smallest = collections.defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        smallest[find(i)] = min(smallest[find(i)], r[0])
    return {r[0]: (len(sets[i]), smallest[find(i)]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("n, percent, rows, bands", [(3, 85, 5, 24), (5, 80, 4, 30)])
def test_near_duplicates_equal_all_pairs(spark, corpus, n, percent, rows, bands):
    got = near_dup.near_duplicates(spark.createDataFrame(corpus, DOCS), n, percent, rows, bands).collect()
    want = brute_components(corpus, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(corpus)


def test_without_copies_keeps_one_row_of_a_group(spark):
    text = " ".join(f"t{i}" for i in range(40))
    data = [(4, text), (4, text), (2, text + " more"), (None, "only one without id"), (None, "another text that has no id at all"), (7, ""), (7, "")]
    got = near_dup.without_copies(spark.createDataFrame(data, "doc_id BIGINT, text STRING")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted(
        [(2, text + " more"), (-1, "only one without id"), (-1, "another text that has no id at all"), (7, ""), (7, "")]
    )
    assert near_dup.without_copies(spark.createDataFrame([], "doc_id BIGINT, text STRING")).collect() == []


def test_signature_agreement_estimates_similarity():
    import pyarrow as pa
    from foreshock.llm.words import slices

    rng = random.Random(2)
    a = words(rng, 400, 10**6)
    b = a[:300] + words(rng, 100, 10**6)
    texts = next(slices(pa.array([" ".join(a), " ".join(b)])))[1]
    shingles, begins = near_dup.shingle_sets(texts, 3)
    x, y = set(shingles[: begins[1]]), set(shingles[begins[1] :])
    keys, marks = near_dup.min_max_bands(shingles, begins, 5, 200)
    assert keys.shape == (2, 200) and marks.shape == (2, 1000)
    assert abs((marks[0] == marks[1]).mean() - len(x & y) / len(x | y)) < 0.06


def test_components_of_a_long_path(spark):
    nodes = cut_lineage(spark.range(60).selectExpr("id AS node", "id AS comp"))
    links = cut_lineage(spark.range(58).where("id <> 30").selectExpr("id AS a", "id + 1 AS b"))
    got = {r.node: r.comp for r in contract(nodes, links).collect()}
    assert {got[i] for i in range(31)} == {got[0]} and {got[i] for i in range(31, 59)} == {got[31]} and got[59] == 59 and got[0] != got[31]


def brute_katz(rows):
    tokens = [WORD.findall(lower(t)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    uni, pairs, context = collections.Counter(), collections.Counter(), collections.Counter()
    for w, h in zip(tokens, held):
        if not h:
            before = ["<s>", *w[:-1]]
            uni.update(w), pairs.update(zip(before, w)), context.update(before)
    total, types = sum(uni.values()), len(uni)
    counts = lambda c: [sum(1 for v in c.values() if v == r) for r in range(1, katz.K + 2)]
    d1, d2 = katz.shares(counts(uni)), katz.shares(counts(pairs))
    kept = lambda c, d: c * d[c - 1] if c <= katz.K else c - katz.TAIL
    unknown = 1 - sum(kept(c, d1) for c in uni.values()) / total
    p1 = lambda w: kept(uni[w], d1) / total if uni[w] else unknown
    left, mass = collections.Counter(), collections.Counter()
    for (h, w), c in pairs.items():
        left[h] += c - kept(c, d2)
        mass[h] += p1(w)

    def p(w, h):
        if pairs[h, w]:
            return kept(pairs[h, w], d2) / context[h]
        return left[h] / context[h] / (1 - mass[h]) * p1(w) if context[h] else p1(w)

    for h in ["<s>", *list(uni)[:5]]:  # every distribution adds up to one, with one unknown word
        assert math.isclose(sum(p(w, h) for w in uni) + p("never seen", h), 1, rel_tol=1e-9)
    out = []
    for (i, _), w, h in zip(rows, tokens, held):
        score = sum(math.log10(p(x, y)) for x, y in zip(w, ["<s>", *w[:-1]]))
        base = sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        out.append((i, h, len(w), sum(1 for x in w if uni[x]), total, base, score))
    return out


@pytest.mark.parametrize("size", [30, 400])
def test_katz_scores_equal_direct_computation(spark, size):
    rng = random.Random(size)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % size}" for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "W1 w1 W1"])] + [(5, "w1 w2"), (None, "w3 w1 new")]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id BIGINT, text STRING, score DOUBLE, held_out STRING")
    got = [tuple(r) for r in katz.katz_scores(df).collect()]
    key = lambda r: (r[0] is None, r[0], r[2], r[6])
    for a, b in zip(sorted(got, key=key), sorted(brute_katz(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_katz_with_a_word_that_is_half_of_all_tokens(spark, monkeypatch):
    """Pairs of hot words are dealt over the buckets by the word before; scores stay those of direct computation."""
    rng = random.Random(21)
    rows = [(i, " ".join("the" if rng.random() < 0.5 else f"w{rng.randint(0, 150)}" for _ in range(rng.randint(1, 90)))) for i in range(120)]
    rows.append((500, "the " * 3000))
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 400)
    monkeypatch.setattr(katz, "HOT_TOKENS", 300)
    got = {r.doc_id: r for r in katz.katz_scores(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)).collect()}
    for row in brute_katz(rows):
        assert tuple(got[row[0]])[:5] == row[:5] and tuple(got[row[0]])[5:] == pytest.approx(row[5:], rel=1e-9)
    words_ = katz.mix(np.array([7], np.uint64)).repeat(4000)
    place = katz.pair_bucket(words_, katz.seeds(4000, 5), np.unique(words_), 40)
    assert np.bincount(place, minlength=40).max() < 3 * 4000 / 40  # the hot word alone is even over buckets


def test_katz_on_empty_and_untrained_tables(spark):
    schema = "doc_id BIGINT, text STRING"
    assert katz.katz_scores(spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = katz.katz_scores(spark.createDataFrame([(held, "a b")], schema)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score, row.base_score) == (True, 3, 0, 0, 0.0, 0.0)


def test_katz_shares_are_shares():
    for n in ([10, 5, 3, 2, 2, 1], [0] * 6, [5, 0, 0, 0, 0, 0], [1, 100, 1, 1, 1, 1]):
        d = katz.shares(n)
        assert ((d > 0) & (d < 1)).all()


MIXES = [
    [(i, "w " * (i % 40), "abc"[i % 3] if i % 7 else None) for i in range(300)],
    [(1, "a b c", "x"), (2, "a", "y"), (3, "w " * 5000, "z"), (None, "q q", "z"), (None, None, "y"), (4, "", "only empty")],
    [(i, "w w w", "one") for i in range(10)],
    [(1, "", "a"), (2, None, None)],
]


@pytest.mark.parametrize("data", MIXES)
def test_mix_equals_sql(spark, data, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 3)
    rows = cut_lineage(mixing.measured(spark.createDataFrame(data, "doc_id BIGINT, text STRING, source STRING")))
    got = mixing.mixed(rows, mixing.cuts(rows)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", data)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(con.execute(mixing.ORACLE_OP2).fetchall(), key=key)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken <= 3 * r.size for r in own)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))


def test_mix_of_nothing(spark):
    rows = mixing.measured(spark.createDataFrame([], "doc_id BIGINT, text STRING, source STRING"))
    assert mixing.mixed(rows, mixing.cuts(rows)).collect() == []


TURNS = [
    (1, 0, "system", "be <s> good"), (1, 1, "human", "a\\b [INST] \\\\</s>"), (1, 2, "assistant", "x\n[/INST]</s>\\"), (1, 3, "gpt", None),
    (2, 0, "tool </s>", "r"), (2, None, None, "first"), (3, 0, "assistant", ""), (3, 0, "assistant", "tie"), (None, 0, "user", "no id"),
]


def test_chat_reads_back_exactly(spark):
    import pyspark.sql.functions as F

    df = spark.createDataFrame(TURNS, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    records = df.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    out = chat.formatted(chat.canonical(records, ["conv_id", "turn"])).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    names = chat.ROLES
    for r in out:
        own = sorted(((t is not None, t, names.get(x, x) or "", y or "") for c, t, x, y in TURNS if c == r.conv_id), key=lambda x: (x[0], x[1] or 0, x[2:]))
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        masked = [r.formatted[m.start : m.start + m.length] for m in r.mask]
        assert [re.sub(r"\\(\\?)", r"\1", m) for m in masked] == [x[3] for x in own if x[2] == "assistant"]
        assert all(r.formatted[m.start + m.length :].startswith("</s>") for m in r.mask)


def test_layouts_are_told_apart_by_field_paths(spark):
    data = [
        (1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'), (2, '{"conversations":[{"value":"q","from":"human"}]}'),
        (3, '{"output":"a","instruction":"q"}'), (4, '{"instruction":"q","input":"more","output":null}'), (5, '{"system":"s","prompt":"q","completion":"a"}'),
        (6, '{"question":"q","answer":"a"}'), (7, '{"unknown":{"question":"q","answer":"a"}}'), (8, '{"text":"t","role":"user"}'),
    ]
    got = collections.defaultdict(list)
    for r in chat.canonical(spark.createDataFrame(data, "id BIGINT, record STRING"), ["id"]).orderBy("id", "part").collect():
        got[r.id].append((r.layout, r.role, r.text))
    assert got[1] == [("messages", "user", "q"), ("messages", "assistant", "a")] and got[2] == [("shared", "user", "q")]
    assert got[3] == [("instruction", "user", "q"), ("instruction", "assistant", "a")]
    assert got[4] == [("instruction", "user", "q"), ("instruction", "user", "more"), ("instruction", "assistant", "")]
    assert got[5] == [("prompt", "system", "s"), ("prompt", "user", "q"), ("prompt", "assistant", "a")]
    assert got[6] == [("question", "user", "q"), ("question", "assistant", "a")] and got[7] == [(None, None, None)] and got[8] == [("message", "user", "t")]


def test_leaks_verbatim_reworded_and_inconsistent(spark):
    item = "A train leaves Paris at 9 and meets Anna after 120 km while Bob and Anna wait 3 hours near the old bridge of the town"
    other = item.replace("Anna", "Carla").replace("120 km", "75 miles").replace("9", "11")
    wrong = item.replace("meets Anna", "meets Carla").replace("and Anna", "and Dora").replace("120", "75")
    rng = random.Random(4)
    pad = lambda n: " ".join(words(rng, n))
    docs = [(0, None), (1, ""), (2, pad(300))]
    docs += [(10 + k, f"{pad(k)} {item} {pad(20)}") for k in range(6)] + [(20 + k, f"{pad(k)} {other} {pad(9)}") for k in range(6)]
    docs += [(30 + k, f"{pad(k)} {wrong}") for k in range(6)] + [(40, pad(7) + " short one here"), (10, docs[3][1]), (None, item.upper())]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id BIGINT, text STRING, item_id INT")
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (2, "short one here", "z"), (3, None, ""), (None, "", "")], "item_id BIGINT, text STRING, doc_id STRING")
    got = decontaminate.leaks(df, bench).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert {k for k in found if k[1] == 1} >= {(10 + k, 1) for k in range(6)} | {(20 + k, 1) for k in range(6)}
    assert not {(30 + k, 1) for k in range(6)} & set(found) and not {(i, 1) for i in (0, 1, 2, 40)} & set(found)
    assert (40, 2) in found and len(got) == len(found)
    assert all(found[20 + k, 1].reworded and not found[10 + k, 1].reworded for k in range(6))
    left = {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()}
    assert {0, 1, 2} <= left and not left & set(range(10, 26))
    assert decontaminate.leaks(df, bench.limit(0)).collect() == [] and decontaminate.without_leaks(df.limit(0), bench).collect() == []


def test_leaks_whose_values_are_wrapped_or_changed_once(spark):
    item = "A train leaves Paris at 12 and meets Anna after 12 hours while Bob told Anna of the PARIS office near the old bridge of the town"
    cases = [item, item.replace("told Anna", "told\nAnna"), item.replace("told Anna", "told  Anna"), item.replace("after 12", "after 15")]
    cases += [item.replace("Bob", "Anna"), item.replace("Anna", "Carla").replace("12", "15")]
    cases += [item.replace("meets Anna", "meets Carla").replace("told Anna", "told Dora").replace("12", "15", 1).replace("after 12", "after 17")]
    df = spark.createDataFrame([(k, "so it goes, " * 5 + t) for k, t in enumerate(cases)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in decontaminate.leaks(df, spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")).collect()}
    assert set(got) == set(range(6)) and all(r.n_matched == r.n_tokens for r in got.values())


def test_edited_leaks_are_found_at_every_position(spark):
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    texts, docs = {1: words(21), 2: words(10)}, []
    texts[3] = [x for k, w in enumerate(words(6)) for x in (f"{k + 3}", f"{k + 50}", f"{k + 70}", w)]  # three placeholders of four
    for shift in range(8):
        before = words(5 + shift)
        docs.append((1, [*before, *(x if i not in (3, 10, 17) else "other" for i, x in enumerate(texts[1])), "end"]))
        docs += [(2, [*before, *(x if i != at else "other" for i, x in enumerate(texts[2]))]) for at in range(10)]
        docs.append((3, [*before, *(f"1{x}" if x.isdigit() else x for x in texts[3])]))
    df = spark.createDataFrame([(k, " ".join(t)) for k, (_, t) in enumerate(docs)], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "item_id BIGINT, text STRING")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(k, item) for k, (item, _) in enumerate(docs)}


def test_leaks_with_words_put_in_or_left_out(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    item, before = words(40), words(9)
    item[7], item[15], item[33] = "Anna", "12", "Anna"
    longer = [w for x in item for w in (("Mary", "Jane") if x == "Anna" else (x,))]
    cases = [[*item[:20], "extra", *item[20:]], [*item[:20], *item[21:]], longer, [*item[:13], *words(40), *item[13:]], item[::-1], item]
    df = spark.createDataFrame([(k, " ".join([*before, *c, *before])) for k, c in enumerate(cases)], "doc_id BIGINT, text STRING")
    df = df.unionByName(df.selectExpr("doc_id + 10", f"substr(text, {len(' '.join(before)) + 2}) AS text").toDF("doc_id", "text"))
    got = {r.doc_id: r for r in decontaminate.leaks(df, spark.createDataFrame([(1, " ".join(item))], "item_id BIGINT, text STRING")).collect()}
    assert set(got) == {0, 1, 2, 5, 10, 11, 12, 15}
    assert [got[k].n_matched for k in (0, 1, 2, 5)] == [40, 39, 40, 40] and all(got[k].start == 9 and got[k + 10].start == 0 for k in (0, 1, 2, 5))

def plain_forms(text):
    """Tokens, their lower case and their typed forms by the rules of the docstring."""
    marked = regex.sub(r"(?<=[\p{Ll}\p{N},;] )(\p{Lu}\p{L}+)", "§\\1", (text or "").replace("§", " "))
    words_ = regex.findall(r"\p{N}(?:[\p{N}.,:/]*\p{N})?|§?\p{L}+", marked)
    plain = [w.lstrip("§").lower() for w in words_]
    form = ["0" if regex.match(r"\p{N}", w) else "§" if w[0] == "§" else w.lower() for w in words_]
    form = ["%" if i and form[i - 1] == "0" and f in decontaminate.UNITS else f for i, f in enumerate(form)]
    return plain, form


def plain_leak(text, item):
    """Most matched tokens over all placements of an item that pass the rules, or none. A placement counts if one of the item's windows
    is met whole by a window that is not of placeholders alone, without a lower-case word that is marked beside a replaced name."""
    (plain, form), (own, own_form) = plain_forms(text), plain_forms(item)
    size, need, best = len(own), -(-len(own) * 4 // 5), None
    n = min(6, size // (size - need + 1))
    words_ = regex.findall(r"\p{N}(?:[\p{N}.,:/]*\p{N})?|\p{L}+", item.replace("§", " "))
    same = lambda i, j: 0 <= j < len(plain) and (own_form[i] == form[j] or own[i] == plain[j])

    def passes(pairs):
        met = [(own[i], plain[j]) for i, j in pairs if own_form[i] in "0§%"]
        changed = [p for p in met if p[0] != p[1]]
        swaps = set(changed)
        broken = sum(1 for p in changed if sum(q[0] == p[0] or q[1] == p[1] for q in swaps) != 1)
        return len(pairs) >= need and (len(met) - broken >= math.ceil(len(met) * 0.8) or len(pairs) - len(changed) >= math.ceil(size * 0.9))

    def met_whole(start):
        for k in range(0, n * (size // n), n):
            at = [(i, start + i) for i in range(k, k + n)]
            if all(same(i, j) for i, j in at):
                if all(own[i] == plain[j] for i, j in at):
                    return True
                marked = any(form[j] == "§" and not words_[i][0].isupper() for i, j in at)
                renamed = any(form[j] == "§" and own[i] != plain[j] for i, j in at)
                if any(form[j] not in "0§%" or marked and form[j] == "§" for _, j in at) and not (marked and renamed):
                    return True
        return False

    for start in range(-size, len(plain)):
        pairs = [(i, start + i) for i in range(size) if same(i, start + i)]
        if passes(pairs) and met_whole(start) and (best is None or len(pairs) > best):
            best = len(pairs)
    return best


def test_leaks_equal_brute_force_over_random_edits(spark):
    """Every document that brute force finds at one offset is found with as many tokens, and the SQL finds the same rows."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    fill = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    names, units = ["Anna", "Bob", "Carla", "Dora", "Paris"], ["km", "miles", "hours", "kg", "yards"]

    def item():
        out = fill(rng.randint(4, 25))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(out))
            out[at : at + 1] = rng.choice([[rng.choice(names)], [str(rng.randint(1, 99)), rng.choice(units)], [str(rng.randint(1, 9))]])
        return out

    bench = [item() for _ in range(25)]

    def edited(words_):
        out, swap = list(words_), {x: rng.choice(units if x in units else names) for x in units + names}
        numbers = rng.random() < 0.5
        out = [str(int(x) + 7) if numbers and x.isdigit() else swap[x] if numbers and x in swap else x for x in out]
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(out))
            out[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [], [out[at], rng.choice(vocabulary)], [out[at].upper()]])
            out = out or ["x"]
        return out

    docs = [(k, " ".join([*fill(rng.randint(0, 9)), *edited(rng.choice(bench)), *fill(rng.randint(0, 9))])) for k in range(150)]
    docs += [(200 + k, " ".join(fill(40))) for k in range(20)] + [(300, "How many km is 30 yards, she asked"), (301, None), (302, "")]
    bench = [(k, " ".join(b)) for k, b in enumerate(bench)] + [(50, "How many metres is 12 miles, she asked"), (51, None), (None, bench[0][0])]
    df, items = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(bench, "item_id BIGINT, text STRING")
    got = [tuple(r) for r in decontaminate.leaks(df, items).drop("text_hash").collect()]
    matched = {r[:2]: r[4] for r in got}
    for doc_id, text in docs:
        for item_id, words_ in bench[:-1]:
            if words_ and (want := plain_leak(text, words_)):
                assert matched.get((doc_id, item_id)) == want, (doc_id, item_id, want)
    assert (300, 50) in matched and {r[0] for r in got} - set(range(200)) <= {300} | set(range(200, 220))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", bench)
    assert sorted(con.execute(decontaminate.ORACLE_OP10).fetchall(), key=str) == sorted(got, key=str)


def test_digest_of_probe_is_that_of_the_contract():
    want = hashlib.sha256("".join(f"{r}\n{chat.PROBE}\n" for r in ("user", "assistant")).encode()).hexdigest()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    assert con.execute(chat.ORACLE_OP5).fetchall()[0][:3] == (-7, 2, want)
