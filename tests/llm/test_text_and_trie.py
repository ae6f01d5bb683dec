"""Collocations, prefix tries and disclosure against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import collocations, disclosure, prefix_trie

# ------------------------------------------------------------------------ 11


def plain_phrases(docs, least, top=2000, most=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        held = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in held.items():
            if any(len(q) > len(p) and 100 * c >= 100 * a and inside(p, q) for q, c in held.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, l, r, n[lang], score))
        out += [(lang, i + 1, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(rows)[:top])]
    return out


def phrase_docs():
    rnd = random.Random(3)
    words = ["a", "b", "B", "Ää", "c\x01", "dd", "x-y"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    texts += ["z " * 300, "q q q q q q q", None, "", " .. ", texts[0], texts[0], "\r\x0b;a b"]
    return [(t, [None, "en", "de", "und"][i % 4] if i % 3 else "en") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("least", "bits", "parts"), [(4, 22, "4"), (2, 16, "7"), (300, 22, "4")])
def test_collocations(spark, least, bits, parts):
    docs = phrase_docs()
    df = spark.createDataFrame([(t, g, "r", 1, "p", 2) for t, g in docs], "text string, lang string, rank string, n long, phrase string, word long").repartition(5)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in collocations.mine(df, least=least, filter_bits=bits, filter_least=3).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    want = plain_phrases(docs, least)
    assert sorted(got) == sorted(want)
    assert want or least == 300
    assert collocations.mine(df.limit(0), least=least).collect() == []


def test_top_phrases_and_split_ranges(spark):
    docs = phrase_docs()
    df = spark.createDataFrame([(t, g) for t, g in docs], "text string, lang string")
    assert sorted(tuple(r) for r in collocations.mine(df, least=2, top=3).collect()) == sorted(plain_phrases(docs, 2, 3))


@pytest.mark.parametrize("cuts", [[], [1], [5], [2, 3, 9]])
def test_parts_of_a_split_range_join(cuts):
    rnd = random.Random(1)
    rows = Counter(("en", " ".join(rnd.choice("ab") for _ in range(rnd.randint(2, 5))).encode() + b" ") for _ in range(200))
    ordered = sorted(((g, s, n) for (g, s), n in rows.items()), reverse=True)
    want = Counter()
    for g, s, n in ordered:
        w = s.split()
        for k in range(2, len(w) + 1):
            want[b" ".join(w[:k]).decode()] += n
    got, edges = Counter(), [0, *cuts, len(ordered)]
    for a, b in zip(edges, edges[1:]):
        for _, p, n in collocations.count_prefixes(iter(ordered[a:b]), 10):
            got[p] += n
    assert {p: n for p, n in got.items() if n >= 10} == {p: n for p, n in want.items() if n >= 10}


def test_filter_never_loses_a_pair():
    h = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    codes = np.random.default_rng(1).integers(0, 50, 5000)
    one = collocations._buckets(h, codes, "en", 16)
    assert (one == collocations._buckets(h, codes, "en", 16)).all() and one.max() < 1 << 16
    assert len(set(zip(codes[:-1].tolist(), codes[1:].tolist()))) >= len(set(one.tolist()))


# ------------------------------------------------------------------------ 12


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seq = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += children[p] == 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(seq[c]) == len(p)))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items()]


def talk_rows():
    rnd = random.Random(8)
    rows = []
    for c in range(90):
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t if rnd.random() > 0.05 else None, rnd.choice(["user", None]), rnd.choice(["", "ä", "hello", None])))
    for c in range(200, 290):  # copies of one conversation, a third of all, and one very long
        rows += [(c, t, "user", "same") for t in range(4)]
    rows += [(400, t, "user", f"long {t // 2}") for t in range(700)] + [(401, t, "user", f"long {t // 2}") for t in range(700)]
    rows += [(500, 1, "a", "x"), (500, 1, "a", "x"), (500, 1, "a", "w"), (None, 1, "a", "x"), (503, 0, "b:", "y"), (504, 0, "b", ":y"), (3003, 0, "a", "")]
    return rows


@pytest.mark.parametrize(("shard", "upper", "build"), [(4096, 100_000, 200_000), (3, 100_000, 5), (1, 40, 7)])
def test_prefixes(spark, shard, upper, build):
    rows = talk_rows()
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, n long, key string, size long").repartition(5)
    got = prefix_trie.prefixes(df, shard_convs=shard, upper=upper, build=build).collect()
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got) == sorted(plain_trie(rows))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefixes(empty).collect() == []


def test_louds_gives_back_the_tree():
    rnd = random.Random(2)
    n = 300
    parent = np.array([-1 if i < 3 else rnd.randrange(i) for i in range(n)])
    labels = np.array([[rnd.randrange(9), i] for i in range(n)], np.uint64)
    trie = prefix_trie.Louds(parent, labels)
    assert len(trie.bits) == 2 * n + 1 and trie.bits.sum() == n
    up = trie.parents()
    for node in range(1, n + 1):
        row = trie.rows[node - 1]
        assert (up[node - 1] == 0) if parent[row] < 0 else trie.rows[up[node - 1] - 1] == parent[row]
    assert (trie.degrees()[1:] == [np.sum(parent == r) for r in trie.rows]).all()
    size = trie.totals(np.concatenate(([0], np.ones(n, np.int64))))
    below = lambda r: 1 + sum(below(i) for i in np.flatnonzero(parent == r))
    assert size[0] == n and all(size[i + 1] == below(r) for i, r in enumerate(trie.rows))


# ------------------------------------------------------------------------ 13

# The patterns of the contract.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255 or kind == "card" and not (13 <= len(digits) <= 19 and doubled % 10 == 0) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def found(text):
    return [(k, a, b) for k, v in disclosure.base_spans(text).items() for a, b in v]


def test_spans_are_those_of_the_patterns():
    rnd = random.Random(6)
    alphabet = ["a", "@", ".", "1", "25", "0", "-", "+1", " ", "(", ")", "é", "_", "4111 1111 1111 1111", "+49 30 1234567", "10.0.0.7", "x@y.zz", "\n"]
    for _ in range(4000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 24)))
        assert found(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+" + " " * 300_000, "@" * 100_000, "+1" * 100_000, "a@b." * 80_000):
        found(text)


def person_docs():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    some = lambda n: " ".join(word() for _ in range(n))
    rows = [f"{some(20)} Zora Quill {some(2)} zq@mail.example.org {some(20)}\n{some(9)}" for _ in range(6)]
    rows += [f"{some(20)} other{i}@mail.example.org {some(3)} the the" for i in range(40)] + [f"the {some(40)} the" for _ in range(60)]
    rows += [rows[0]] * 5 + [None, "", "Zora Quill alone", "x" * 200_000 + " +1 (499) 555-6503"]
    once = f"{some(5)} Unseen solo@mail.example.org"
    return [*rows, *[once] * 9]


def test_terms_that_give_away(spark):
    rows = person_docs()
    df = spark.createDataFrame([(i if i % 7 else None, t, "b", 1, "z") for i, t in enumerate(rows)], "doc_id long, text string, base string, n_ip long, spans string").repartition(4)
    got = disclosure.sanitise(df).collect()
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    for r in disclosure.detect(df, keep={"t": df.text}).collect():
        by_text[r["t"]].add((r["spans"], r["n_email"]))
    for text, spans in by_text.items():
        (one, _), *more = spans
        assert not more
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text or ""))
        terms = [(text or "")[int(a) : int(b)] for k, a, b in (s.split(":") for s in one.split(",") if s) if k == "term"]
        assert one.startswith(base)
        assert terms == (["Zora", "Quill"] if text and "zq@" in text else [])
    clean = [r["text"] for r in got if r["spans"] and "term" in r["spans"]]
    assert len(clean) == 11 and all("[email mail.example.org]" in t and "Zora" not in t and "zq@" not in t for t in clean)


def test_disclosure_digest(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    hashed = lambda s: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
    want = [(i, *(sum(s[0] == k for s in plain_spans(t)) for k in PLAIN), hashed(plain_spans(t))) for i, t in rows]
    got = disclosure.digest(odd_docs)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(repr(tuple(r)[:6]) for r in got.collect()) == sorted(map(repr, want))
    assert disclosure.digest(no_docs).collect() == []


def test_cleaned():
    text = "Ann a@b.cc at 10.1.2.3 or +49 30 1234567"
    spans = ",".join(["term:0:3", *(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))])
    assert disclosure.cleaned(text, spans) == "[term] [email b.cc] at [ip 10.1] or [phone +49]"
