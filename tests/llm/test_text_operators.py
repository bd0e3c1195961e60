"""Operators on single texts: words, repetition, secrets, licences."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foreshock.llm import licenses, quality_rules, secrets
from foreshock.llm.words import grams, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \t\n", "one", "Ab aB", "a  b c\td", "x" * 3000, "ünï cödé 字 字\n字", "a b c a b c a b c\nq\nq\n q\n\n\nq",
    " ".join(["w%d" % (i % 7) for i in range(400)]), "#tag <b> | $5 & 10% *",
]
DOCS = "doc_id BIGINT, text STRING, source STRING, lang STRING, n_words BIGINT"


def rows(texts):
    return [(i, t, "s", "en", -1) for i, t in enumerate(texts)]


def test_words_match_pattern_and_hashes_are_of_the_words():
    seen = {}
    for limit in (1, 64, 1 << 20):
        for at, texts in slices(pa.array(TEXTS), limit):
            hashes = texts.hashes(lower=False)
            for i in range(len(texts)):
                raw = (TEXTS[at + i] or "").encode()
                low, high = texts.bounds[i], texts.bounds[i + 1]
                base = texts.offsets[i]
                got = [raw[a - base : b - base].decode() for a, b in zip(texts.starts[low:high], texts.ends[low:high])]
                assert got == WORD.findall(TEXTS[at + i] or "")
                for word, h in zip(got, hashes[low:high]):
                    assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hash_of_long_word_does_not_depend_on_its_place():
    long = "z" * 700_000
    a = [t.hashes()[-1] for _, t in slices(pa.array([long]))][0]
    b = [t.hashes()[-1] for _, t in slices(pa.array(["q " * 300_000 + long]))][0]
    assert a == b
    assert len(grams(np.arange(2, dtype=np.uint64), 3)) == 0


def plain_rules(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    repeat = set()
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeat |= {p + k for p in places for k in range(3)}
    full = [x for x in lines if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(repeat),
        len(words) < 50 or 100 * len(repeat) > 50 * len(words),
    )


def test_repetition_base_columns(spark):
    rng = random.Random(3)
    texts = [*TEXTS, *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 300))) for _ in range(40))]
    got = {r.doc_id: r for r in quality_rules.repetition(spark.createDataFrame(rows(texts), DOCS)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(t)
        assert not (r.kept and r.base_failed)


def test_repetition_verdict(spark):
    rng = random.Random(5)
    clean = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300))
    line = " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(12))
    half = " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(150))
    texts = [clean, clean + ("\n" + line) * 12, half + " " + half]
    got = {r.doc_id: r for r in quality_rules.repetition(spark.createDataFrame(rows(texts), DOCS)).collect()}
    assert [got[i].kept for i in range(3)] == [True, False, False]
    assert got[2].dup_10gram_chars == got[2].word_chars
    assert quality_rules.repetition(spark.createDataFrame([], DOCS)).collect() == []


BASE = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]


def plain_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in pattern.finditer(text or ""):
            if kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                out.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


SECRETS = [
    None, "", "nothing here", "ü PassWord = 'abcdef' and token:xy12 then secret=zzzzzz", "AKIA" + "A1" * 8 + " AKIASHORT",
    "deadbeef" * 3, "f" * 24 + "g" + "0" * 23, "api_key: " + "0123456789abcdef" * 2 + " x", "APIKEY=token=abcdefg", "a1" * 12 + "\nb2" * 3,
    "pwd: xK9#mQ2$vL7p", "Authorization: Bearer abC9xx81Zq", "pass = hello", "the pass is open",
]


def test_secret_base_spans_and_additions(spark):
    df = secrets.secret_spans(spark.createDataFrame(rows(SECRETS), DOCS))
    got = {r.doc_id: r for r in df.collect()}
    for i, t in enumerate(SECRETS):
        want = plain_spans(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(got[i].spans.split(","))
    assert got[10].spans == "guess:5:17" and got[11].n_added == 1 and got[12].spans == "" and got[13].spans == ""


def test_masking_replaces_spans_only(spark):
    df = secrets.mask_secrets(spark.createDataFrame(rows(SECRETS), DOCS))
    got = {r.doc_id: r.text for r in df.collect()}
    assert got[0] is None and got[2] == SECRETS[2] and got[3] == "ü [SECRET]' and token:xy12 then [SECRET]"
    assert got[10] == "pwd: [SECRET]" and df.columns == ["doc_id", "text", "source", "lang", "n_words"]


def test_values_beyond_base_spans_after_prefixes_and_of_letters(spark):
    texts = [
        "password=hunter2!Xk9$vQz7#Lw end", "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", "DB_PASS=q8wZ5tyLmiop x", "MYSQL_PWD: q8wZ5tyLmiop",
        "passphrase: qXzRtLmVbNwPkJhGdS", "token=abcdefgh12345678", "the password is incorrect", "secret: Zusammenfassung", "passcode: everything.", "pass: akqmdkrzpslw",
        "Zusammenfassung: everything incorrect",
    ]
    df = spark.createDataFrame(rows(texts), DOCS)
    got = {r.doc_id: r for r in secrets.secret_spans(df).collect()}
    assert [got[i].n_added for i in range(10)] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 1] and got[0].spans == "assign:0:16,guess:9:28"
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    assert masked[0] == "[SECRET] end" and masked[2] == "DB_PASS=[SECRET] x" and masked[4] == "passphrase: [SECRET]" and masked[8] == texts[8]


@pytest.mark.parametrize("weak, strong", [("password", "7602ad27cf55"), ("qwertyuiop", "q8wZ5ty#iop"), ("aaaaaaaaaaaa", "akqmdkrzpslw"), ("12.05.1998", "1720591983")])
def test_guess_cost_order(weak, strong):
    assert secrets.log_guesses(weak) < secrets.log_guesses(strong)


def test_guess_cost_is_at_most_brute_force_and_never_negative():
    rng = random.Random(1)
    for _ in range(200):
        v = "".join(rng.choice("abc123XY#") for _ in range(rng.randint(1, 20)))
        assert 0 <= secrets.log_guesses(v) <= len(v) * np.log10(92) + 1e-9


def plain_guesses(value, words):
    """The minimum over all ways to cut ``value``, each part priced by itself."""
    per_char, (low, plain) = np.log10(secrets.alphabet(value)), secrets.folded(value)

    def price(i, j):
        part, out = value[i:j], [(j - i) * per_char, words.cost(value, low, plain, i, j)] if j - i >= 3 else [(j - i) * per_char]
        if j - i >= secrets.WALK and all(low[k : k + 2] in secrets._NEXT for k in range(i, j - 1)):
            out.append(secrets.WALK_COST + (j - i - 1) * secrets.STEP_COST)
        for u in range(1, secrets.PERIOD + 1):
            if j - i > u and all(part[k] == part[k - u] for k in range(u, j - i)):
                out.append(u * per_char + secrets.REPEAT_COST + (j - i - u) * secrets.STEP_COST)
        for k, date in enumerate(secrets._DATES):
            if (found := date.match(value, i)) and found.end() == j:
                out.append(secrets._DAY if k else secrets._YEAR)
        return min(out)

    costs = [price(0, len(value))]
    for cut in range(1, 1 << (len(value) - 1)):
        at = [0, *(k + 1 for k in range(len(value) - 1) if cut >> k & 1), len(value)]
        costs.append(sum(price(i, j) for i, j in zip(at, at[1:])) + secrets.PART_COST * (len(at) - 2))
    return min(costs)


@pytest.mark.parametrize("value", [
    "", "a", "hunter1998", "Passw0rdqwe", "aaaaabbbbb", "xqwertyuu", "ababab1.2.99", "monkeyqweas", "1qaz2wsx3e", "zzz19991231", "Ünïqwdragon", "logınİqwe12",
])
def test_guess_cost_is_the_minimum_over_all_cuts(value):
    words = secrets.Words(["dragonfly", "uniq", "keyq", "was"])
    if value:
        assert secrets.log_guesses(value, words) == pytest.approx(plain_guesses(value, words), abs=1e-9)
    assert value or secrets.log_guesses(value, words) == 0


def test_guess_cost_is_the_minimum_on_random_values_and_may_stop_early():
    rng, words = random.Random(7), secrets.Words(["qwe", "abca", "bcab", "weas"])
    for _ in range(40):
        value = "".join(rng.choice(["a", "b", "c", "qw", "e", "as", "1", "2", "1999", ".", "A"]) for _ in range(rng.randint(1, 7)))[:11]
        least = plain_guesses(value, words)
        assert secrets.log_guesses(value, words) == pytest.approx(least, abs=1e-9)
        for bar in (2.0, 4.0, 6.0, 8.0):
            assert (secrets.log_guesses(value, words, bar) >= bar) == (secrets.log_guesses(value, words) >= bar)


def test_secrets_of_words_of_the_corpus_and_of_none(spark):
    texts = [
        "passphrase: correcthorsebatterystaple", "passphrase=bakolimerusatinopegudalovemi", "the secret is trustworthiness", "trustworthiness matters",
        "password: " + "x" * 40, "token: \u5bc6\u7801\u5728\u8fd9\u91cc\u8bf7\u52ff\u5206\u4eab", "pwd: " + "pq7Z" * 500_000, "pwd: xK9#mQ2$vL7p", "pwd: xK9#mQ2$vL7p", None, "",
    ]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows(texts), DOCS)).collect()}
    assert [got[i].n_added for i in range(11)] == [1, 1, 0, 0, 0, 0, 1, 1, 1, 0, 0]
    assert got[6].spans == "guess:5:2000005" and got[7].spans == got[8].spans == "guess:5:17"


def test_frequent_words_leave_out_credential_values(spark):
    texts = ["the cat and the dog", "password is zebra the", "pass: tiger tiger", None, "", "THE Ünder" + "a" * 30]
    df = spark.createDataFrame(rows(texts), DOCS)
    assert secrets.frequent_words(df) == ["the", "and", "cat", "dog", "tiger"] and secrets.frequent_words(df, limit=1) == ["the"]
    assert secrets.frequent_words(df.limit(0)) == [] and secrets.secret_spans(df.limit(0)).collect() == []


def test_many_credentials_in_one_text(spark):
    text = "token=abcdef123 " * 50_000
    got = secrets.secret_spans(spark.createDataFrame(rows([text]), DOCS)).collect()[0]
    assert (got.n_assign, got.n_added) == (50_000, 0)


def plain_dice(a, b):
    x, y = licenses.bigrams(a), licenses.bigrams(b)
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0.0


def test_license_lines_against_all_templates(spark):
    texts = [
        None, "", "word", "Released under the MIT License.\nfoo bar", "intro\nLicensed under the  APACHE license,\nversion 2.0!\nmore text",
        "all rights reserved", "All rights are reserved to nobody in particular here", "Licensed under CC-BY-NC 4.0", "under the sea\n" * 50,
    ]
    got = {}
    for r in licenses.license_matches(spark.createDataFrame(rows(texts), DOCS)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.first_line, r.last_line))
    assert got[3] == [("MIT", 0, 0)] and got[4] == [("Apache-2.0", 1, 2)] and got[5] == [("Proprietary", 0, 0)] and got[7] == [("CC-BY-NC-4.0", 0, 0)]
    assert not {0, 1, 2, 6, 8} & set(got)
    for i, t in enumerate(texts):  # one line is near to a template exactly where a match covers it
        for k, line in enumerate((t or "").split("\n")):
            if any(plain_dice(line, x) >= licenses.DICE for group in licenses.TEMPLATES.values() for x in group):
                assert any(a <= k <= b for _, a, b in got[i])


def found_licenses(spark, texts, **more):
    out = {}
    for r in licenses.license_matches(spark.createDataFrame(rows(texts), DOCS), **more).collect():
        out.setdefault(r.doc_id, []).append((r.license, r.start, r.end, r.dice, r.template))
    return {i: sorted(x, key=lambda y: y[1]) for i, x in out.items()}


def test_licenses_beside_other_words_and_whole_bodies(spark):
    body = next(t for t in reversed(licenses.TEMPLATES["MIT"]))
    isc = licenses.TEMPLATES["ISC"][1]
    wrapped = "\n * ".join(re.findall(r".{1,40}(?: |$)", body))
    texts = [
        "Copyright (c) 2020 Foo Inc. All rights reserved.", "Copyright (c) 2020 Foo Inc. Licensed under the MIT License.",
        "Here \u00fc is what we say: " + isc + " And so on.", licenses.TEMPLATES["MIT"][4], "/*\n * Copyright 2019 A B\n * " + wrapped + "*/",
        "word " * 30_000 + "Licensed under the Apache License, Version 2.0. " + "word " * 30_000, "All rights reserved. " * 300, "2001 2002 2003", "x" * 300_000,
        licenses.TEMPLATES["GPL-3.0-or-later"][0] + "\n\n" + licenses.TEMPLATES["BSD-3-Clause"][-1], None,
    ]
    got = found_licenses(spark, texts)
    assert [[x[0] for x in got.get(i, [])] for i in range(11)] == [
        ["Proprietary"], ["MIT"], ["ISC"], ["MIT"], ["MIT"], ["Apache-2.0"], ["Proprietary"] * 300, [], [], ["GPL-3.0-or-later", "BSD-3-Clause"], [],
    ]
    assert texts[0][got[0][0][1] : got[0][0][2]] == "All rights reserved" and texts[2][got[2][0][1] : got[2][0][2]] == isc[:-1]
    assert got[4][0][4] == body and got[5][0][1] == 150_000


def test_licenses_equal_brute_force_over_windows(spark):
    rng = random.Random(3)
    templates = {"A": ["a b c d e f", "c d a"], "B": ["b c b c a b c", "f e d 2020 a"], "C": ["a a a a"]}
    texts = [" ".join(rng.choice("aabbccdef") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += ["a b c d e f " * 6, "a " * 30, "a b x c d e f\na b c d 1999 e f", "a b c", "c d a"]
    got = found_licenses(spark, texts, templates=templates)
    flat = [t for group in templates.values() for t in group]
    for i, text in enumerate(texts):
        spans = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9]+", text)]
        values = {}
        for a in range(len(spans)):
            for b in range(a + 1, min(len(spans), a + 16)):
                values[spans[a][0], spans[b][1]] = max(plain_dice(text[spans[a][0] : spans[b][1]], t) for t in flat)
        mine = got.get(i, [])
        for name, start, end, value, template in mine:
            assert template in templates[name] and value == pytest.approx(plain_dice(text[start:end], template)) and value >= licenses.DICE
            assert value == pytest.approx(values[start, end])
        assert all(x[2] <= y[1] for x, y in zip(mine, mine[1:]))
        assert max((x[3] for x in mine), default=0) == pytest.approx(max((v for v in values.values() if v >= licenses.DICE), default=0))
        for (start, end), value in values.items():  # nothing near enough is left between the matches
            assert value < licenses.DICE or any(start < y and x < end for _, x, y, _, _ in mine)


def test_licenses_of_odd_tables(spark):
    schema = "doc_id BIGINT, text STRING, license STRING, start BIGINT, dice DOUBLE"
    notice = "Licensed under CC BY 4.0."
    df = spark.createDataFrame([(None, notice, "x", 1, 0.1), (3, notice, None, None, None), (3, notice, "y", 2, 0.2), (None, None, None, None, None)], schema)
    got = licenses.license_matches(df).collect()
    assert sorted((r.doc_id or 0, r.license, r.start, r.end, r.dice) for r in got) == [(0, "CC-BY-4.0", 0, 24, 1.0), (3, "CC-BY-4.0", 0, 24, 1.0), (3, "CC-BY-4.0", 0, 24, 1.0)]
    assert licenses.license_matches(df.limit(0)).collect() == [] and licenses.license_matches(df, templates={}).collect() == []
