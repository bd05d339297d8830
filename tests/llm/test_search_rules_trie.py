"""Quality rules, ranked search and the prefix trie, against plain versions and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vicinity.llm import prefix_trie, ranked, repetition
from vicinity.llm.common import all_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, id string, n long, row int, key string, repeats int"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, x, "en", "x", 1, 2, "k", 3) for k, x in texts], SCHEMA).repartition(3)


# --- quality rules ---------------------------------------------------------------------------------------------------
def plain_repeats(words):
    """Every maximal repeat by comparing all pairs of starts: (first start, length, times)."""
    found = {}
    n = len(words)
    for a in range(n):
        for b in range(a + 1, n):
            size = 0
            while b + size < n and words[a + size] == words[b + size]:
                size += 1
            if size and (a == 0 or words[a - 1] != words[b - 1]):
                found[tuple(words[a : a + size])] = size
    out = []
    for run, size in found.items():
        at = [k for k in range(n - size + 1) if tuple(words[k : k + size]) == run]
        out.append((at[0], size, len(at)))
    return sorted(out)


def plain_rules(text, least=3, max_share=40, max_repeat=100):
    words = WORD.findall(text or "")
    runs = Counter(tuple(words[k : k + least]) for k in range(len(words) - least + 1))
    held = {k + x for k in range(len(words) - least + 1) if runs[tuple(words[k : k + least])] > 1 for x in range(least)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    longest = max((size for _, size, _ in plain_repeats(words)), default=0) if len(words) < 200 else None
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    kept = not failed and 100 * len(held) <= max_share * len(words) and (longest or 0) <= max_repeat
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(held), failed, kept, longest


def texts_with_repeats():
    rng = random.Random(2)
    out = [None, "", " \n\t ", "one", "a a a a a", "a b a b a b a", "x #y $%&|<>* é漢\nx\n\n x \nx", "\n".join(["same line here"] * 30)]
    for letters in ("ab", "abc", "abcdefgh"):
        out += [" ".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(25)]
    passage = " ".join(f"p{k}" for k in range(30))
    unique = " ".join(f"u{k}" for k in range(150))
    return out + [f"{passage} {unique}", f"{passage} {unique} {passage}", f"{unique} {unique[:300]}"]


def test_quality_rules_against_all_pairs(spark):
    texts = list(enumerate(texts_with_repeats())) + [(None, "no id"), (3, "one"), (3, "one")]
    rows = repetition.quality_rules(docs_of(spark, texts), list_repeats=True, least=1).collect()
    assert len(rows) == len(texts)
    rows3 = repetition.quality_rules(docs_of(spark, texts)).collect()
    own = defaultdict(list)
    for r in rows3:
        own[r["doc_id"]].append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], r["longest_repeat"]))
    for k, text in texts:
        want = plain_rules(text)
        got = own[k][0] if k is None or len(own[k]) == 1 or text == "one" and want[:4] == own[k][0][:4] else own[k][-1]
        assert got[:7] == want[:7] and (want[7] is None or got[7] == want[7]), (k, text)
    for r in rows:
        if r["doc_id"] not in (None, 3):
            text = dict(texts[: len(texts) - 3])[r["doc_id"]]
            if len(WORD.findall(text or "")) < 200:
                assert [tuple(x) for x in r["repeats"]] == plain_repeats(WORD.findall(text or "")), text
    assert repetition.quality_rules(docs_of(spark, [])).count() == 0


def test_limits_of_the_verdict(spark):
    unique = lambda n, c: " ".join(f"{c}{k}" for k in range(n))
    long = unique(100, "r")
    texts = [(1, f"{long} {unique(400, 'a')} {long}"), (2, f"{long} r100 {unique(400, 'a')} {long} r100"), (3, f"{unique(30, 's')} {unique(60, 'a')} {unique(30, 's')}"), (4, unique(50, "w")), (5, unique(49, "w"))]
    got = {r["doc_id"]: (r["base_failed"], r["kept"], r["longest_repeat"]) for r in repetition.quality_rules(docs_of(spark, texts)).collect()}
    assert got == {1: (False, True, 100), 2: (False, False, 101), 3: (False, False, 30), 4: (False, True, 0), 5: (True, False, 0)}


def test_suffix_array_of_one_word_many_times():
    import pyarrow as pa

    np.seterr(over="ignore")
    w = all_words(pa.array(["z " * 200_000, "y z z"]))
    order, common = repetition.suffix_array(w.hash, w.first)
    assert common.max() == 199_999 and repetition.deepest(order, common)[-3:].tolist() == [0, 1, 1]
    assert repetition.united(repetition.deepest(order, common), 3).sum() == 200_000


# --- ranked search ---------------------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k):
    held = [(i, terms(x)) for i, x in docs]
    n_all, l_all = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(t for _, own in held for t in set(own))
    out = []
    for item, text in items:
        scored = []
        for i, own in held:
            tf, score = Counter(own), 0
            m = 75 + (25 * len(own) * n_all) // l_all if l_all else 0
            for t in terms(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, i if i is not None else -math.inf, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_ranking_against_every_score(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "日本", "A1", "a1"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.randint(2, 65)]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 40))) for k in range(300)]
    docs += [(None, "w1 w2 rare"), (None, "w1 w2"), (7, None), (8, ""), (9, "w1,w2;w1"), (9, "w1,w2;w1"), (400, "common " * 3000)] + [(500 + k, "tie breaker") for k in range(40)]
    items = [(k, text(12)) for k in range(12)] + [(20, "Tie BREAKER tie"), (21, None), (22, ""), (23, "unknown"), (None, "w1 w1"), (24, "rare common é")]
    d = spark.createDataFrame([(i, x, "e", 1) for i, x in docs], "doc_id long, text string, item string, rank int").repartition(4)
    t = spark.createDataFrame([(i, x, "e", 1) for i, x in items], "item_id long, text string, doc_id string, score int")
    monkeypatch.setattr(ranked, "SHARD", 400)
    want = sorted(plain_ranking(docs, items, 5), key=repr)
    assert sorted(map(tuple, ranked.rank_documents(d, t, 5).collect()), key=repr) == want
    few = ranked.rank_documents(d, t, 5, block_bytes=200)
    assert sorted(map(tuple, few.collect()), key=repr) == want
    assert few.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.rank_documents(d.limit(0), t).count() == 0 and ranked.rank_documents(d, t.limit(0)).count() == 0


def test_lists_are_read_only_as_far_as_needed():
    rng = np.random.default_rng(4)
    n, k = 3000, 10
    for lists in (1, 3, 6):
        docs = [rng.permutation(n)[: rng.integers(1, n)] for _ in range(lists)]
        gains = [np.sort(rng.integers(1, 10**6, len(x)))[::-1] for x in docs]
        whole = np.zeros(n, np.int64)
        for x, g in zip(docs, gains):
            whole[x] += g
        edge = np.append(0, np.cumsum([len(x) for x in docs]))
        found, score = ranked.nra(edge[:-1], edge[1:], np.concatenate(docs), np.concatenate(gains), n, k, 0)
        least = np.sort(whole)[-k]
        assert set(np.flatnonzero((whole >= least) & (whole > 0))) <= set(found.tolist()) and (whole[found] == score).all()


# --- prefix trie -----------------------------------------------------------------------------------------------------
def plain_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.md5((hashlib.md5((role or "").encode()).hexdigest() + (text or "")).encode()).digest()
            convs[c].append(((turn is not None, turn or 0), key, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + t[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    rows = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in own if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        rows.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=repr)


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, conv int, seq string, n int").repartition(3)


def some_turns():
    rng = random.Random(8)
    rows = [(1, None, None, None), (1, 0, "user", "hi"), (None, 0, "user", "nobody"), (2, 5, "user", ""), (60, 1, "a", "x y"), (61, 1, "a", "x y"), (-7, 0, "user", "minus"), (41, 0, "u", "only one")]
    for c in range(100, 260):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 2)))))
    rows += [(1000 + k, turn, "user", "copied turn") for k in range(300) for turn in range(2)]
    return rows + [(2000, turn, "user", f"long {turn % 3}") for turn in range(300)]


@pytest.mark.parametrize("size", [4, 1 << 17])
def test_trie_against_plain(spark, size):
    rows = some_turns()
    df = conversations_of(spark, rows)
    built = prefix_trie.rebuilt(prefix_trie.conversations(df))
    want = plain_trie(plain_rebuilt(rows))
    got = prefix_trie.prefix_trie(built, range_turns=size)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_trie_of_nothing(spark):
    none = conversations_of(spark, [])
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.conversations(none))).count() == 0


def test_many_members_of_one_sequence(spark):
    rows = [(k, 0, "user", "same") for k in range(0, 40_000 * 20, 20)]
    got = prefix_trie.prefix_trie(prefix_trie.conversations(conversations_of(spark, rows))).orderBy("depth").collect()
    ends = hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert [(r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in got] == [(0, 40_000, 1, 1, 39_999), (0, 40_000, 0, 1, 39_999)]
    assert got[1]["ends_sha256"] == ends


def test_tree_is_balanced():
    tree = prefix_trie.Tree()
    for k in prefix_trie.median_first(1 << 12):
        tree.insert([k], [1], k)
    depth, deepest, open_ones = 0, 0, [(tree.following[0], 1)]
    while open_ones:
        node, depth = open_ones.pop()
        deepest = max(deepest, depth)
        open_ones += [(x, depth + 1) for x in (tree.smaller[node], tree.larger[node]) if x]
    assert deepest <= 13
