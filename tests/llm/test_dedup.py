"""SimHash groups, repeated spans and repeated lines against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import graph, lines, queries, simhash, spans
from tidemark.llm import words as W

from .conftest import table

VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def fingerprint(text):
    words = VISIBLE.findall(lowered(text))
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = groups(len(rows), [
        (i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4
    ])
    first = {}
    for (i, _), g in zip(rows, root, strict=True):
        first[g] = min((x for x in (first.get(g), i) if x is not None), default=None)
    return Counter((i, f"{p:016x}", first[g]) for (i, _), p, g in zip(rows, prints, root, strict=True))


def test_near_duplicates(docs, rows):
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == near_groups(rows)


def test_near_duplicates_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def noisy_prints(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        x = rng.choice(out)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("node_prints", [12, 100_000])
def test_trie_links_whatever_is_near(spark, node_prints):
    prints = list(dict.fromkeys([*noisy_prints(60, node_prints), 0, 1, (1 << 64) - 1]))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed] * 2 + [(None,)], "print bigint"), 4, node_prints)
    place = {p: i for i, p in enumerate(signed)}
    got = groups(len(prints), [(place[r["u"]], place[r["v"]]) for r in links.collect()])
    want = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    assert got == want


def test_crowded_nodes_keep_their_links(spark):
    # Differing bits high up in both halves, and more prints below them than a task takes.
    flips = (60, 56, 28, 24)
    below = [sum(1 << b for k, b in enumerate((0, 6, 12, 33, 39, 45)) if i >> k & 1) for i in range(64)]
    prints = [x ^ y for x in (0, sum(1 << b for b in flips)) for y in below]
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    place = {p: i for i, p in enumerate(signed)}
    # The two crowds are linked by 4 bits and apart by 3.
    for bits in (4, 3):
        links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print bigint"), bits, 4)
        got = groups(len(prints), [(place[r["u"]], place[r["v"]]) for r in links.collect()])
        assert got == groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= bits])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200), (300, 1_000)]
    pairs += [(500, 501 + i) for i in range(30)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert {got[i] for i in range(1, 41)} == {1}
    assert (got[100], got[95], got[200], got[201], got[1000], got[530]) == (90, 90, 200, 200, 300, 500)
    assert 7 in got and set(got.values()) == {1, 90, 200, 300, 500}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def kept_words(rows, window):
    found = [(i, VISIBLE.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in found:
        for j in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[j : j + window])
                first[key] = min(first.get(key, i), i)
    for i, words in found:
        gone = set()
        for j in range(len(words) - window + 1):
            if i is not None and first[tuple(words[j : j + window])] < i:
                gone.update(range(j, j + window))
        yield i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)


def test_repeated_spans(docs, rows):
    want = list(kept_words(rows, 50))
    got = spans.without_repeats(docs).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(w[2] > 0 for w in want) > 5
    digests = spans.repeats_digest(docs).collect()
    assert Counter(map(tuple, digests)) == Counter((*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want)


def test_paths_name_their_source(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows = [(1, " ".join(words[:120])), (2, " ".join(words[60:200])), (3, "x " + " ".join(words[:200]))]
    rows += [(4, rows[1][1])]
    got = {tuple(r) for r in spans.repeated_paths(table(spark, rows)).select("doc_id", "source", "start", "n_windows", "source_start").collect()}
    # Document 2 shares words 60 to 120 with document 1; document 3 first those of 1, then those of 2.
    assert got == {(2, 1, 0, 11, 60), (3, 1, 1, 71, 0), (3, 2, 72, 80, 11), (4, 2, 0, None, 0)}


def test_paths_follow_branches_of_their_source(spark):
    rng = random.Random(8)
    p, x, y = ([f"w{rng.randrange(10**9)}" for _ in range(n)] for n in (70, 60, 65))
    source = [*p, *x, *p, *y]
    rows = [(1, " ".join(source)), (2, " ".join(["a", *p, *y])), (3, " ".join([*y, "b", *p, *x])), (4, "same " * 120), (5, "same " * 60 + "end")]
    got = [tuple(r) for r in spans.repeated_paths(table(spark, rows)).select("doc_id", "source", "start", "n_windows", "source_start").collect()]
    words = {i: t.split() for i, t in rows}
    covered = {}
    for doc, src, start, n, there in got:
        assert words[doc][start : start + n + 49] == words[src][there : there + n + 49]
        covered.setdefault(doc, []).extend(range(start, start + n))
    # The 21 windows within P by its first place; those that reach into Y by the place of P Y.
    assert {r for r in got if r[0] == 2} == {(2, 1, 1, 21, 0), (2, 1, 22, 65, 130 + 21)}
    assert {r for r in got if r[0] == 3} == {(3, 1, 0, 16, 200), (3, 1, 66, 81, 0)}
    assert sorted(covered[5]) == list(range(11))


def test_repeated_spans_of_nothing(no_docs):
    assert spans.without_repeats(no_docs).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k, i = rng.randrange(3), rng.randrange(len(text) + 1)
        if k == 0:
            text.insert(i, rng.choice("abä"))
        elif i < len(text):
            text[i : i + 1] = [] if k == 1 else [rng.choice("abä")]
    return "".join(text)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        b = edited(rng, a, rng.randrange(5))
        for k in range(4):
            assert lines.within(a, b, k) == (distance(a, b) <= k)


def test_every_close_pair_shares_an_entry():
    rng = random.Random(2)
    size = lambda x: np.array([len(x)])
    look = lambda x: {(int(o[0]), i, x[s[0] : e[0]]) for r, o, i, s, e in lines.entries(size(x)) if len(r)}
    met = 0
    for _ in range(4000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(9, 40)))
        b = edited(rng, a, rng.randrange(3))
        a, b = sorted((a, b), key=len)
        if lines.allowed(len(a)) and distance(a, b) <= lines.allowed(len(a)):
            met += 1
            assert look(a) & look(b)
    assert met > 2000


def repeated(rows, max_share=0.5):
    found = [(i, k, x.strip("\t\n\x0b\x0c\r ")) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    found = [x for x in found if x[2]]
    named = [x for x in found if x[0] is not None]
    texts = sorted({x[2] for x in named})
    root = groups(len(texts), [
        (i, j) for i in range(len(texts)) for j in range(i)
        if abs(len(texts[i]) - len(texts[j])) <= 2 and distance(texts[i], texts[j]) <= lines.allowed(min(len(texts[i]), len(texts[j])))
    ])
    group = dict(zip(texts, root, strict=True))
    first = {}
    for i, k, x in sorted(named):
        first.setdefault(group[x], (i, k))
    for i, t in rows:
        own = [(k, x.strip("\t\n\x0b\x0c\r ")) for k, x in enumerate((t or "").split("\n"))]
        again = {k for k, x in own if i is not None and x and first[group[x]] != (i, k)}
        small = sum(len(x) for k, x in own if k in again) <= max_share * sum(len(x) for _, x in own)
        gone = again if small else set()
        yield i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone), len(gone)


def short(rows):
    """Rows that brute force can compare: without the longest text and repeated ids."""
    return list({i: (i, t) for i, t in rows if i is not None and len(t or "") < 5000}.values()) + [(None, "All rights reserved by the owners of this page.")]


def test_repeated_lines(spark, rows):
    rng = random.Random(4)
    some = short(rows)
    base = ["a line that many have, and each a little differently", "tiny", "ten letter", "twelve chars"]
    some += [(1000 + i, "\n".join([f"own words of number {i * 7919}, none like it {i ** 5}"] + [edited(rng, x, rng.randrange(4)) for x in base])) for i in range(25)]
    got = lines.dedup_lines(table(spark, some)).select("doc_id", "text", "n_removed").collect()
    assert Counter(map(tuple, got)) == Counter(repeated(some))
    assert sum(r["n_removed"] > 0 for r in got) > 10


def test_crowded_entries_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base = "one line of which there are many versions in this small table"
    some = [(i, edited(rng, base, rng.randrange(3)) + f"\nown text {i * 104729} of document {i ** 7}") for i in range(60)]
    monkeypatch.setattr(lines, "CROWD", 7)
    got = lines.dedup_lines(table(spark, some), 0.9).select("doc_id", "text", "n_removed").collect()
    assert Counter(map(tuple, got)) == Counter(repeated(some, 0.9))


def test_repeated_lines_whatever_their_share(spark, rows):
    some = short(rows)
    head, foot = "the head of every page of that site", "the foot of every page of that site"
    some += [(2000 + i, f"{head}\nown {i ** 9}\n{foot}") for i in range(6)] + [(2100, f"{foot}\n{head}"), (2101, f"{head}\nown {2 ** 9}\n{foot}")]
    got = lines.dedup_lines(table(spark, some), None).select("doc_id", "text", "n_removed").collect()
    assert Counter(map(tuple, got)) == Counter(repeated(some, 1.0))
    assert {r["doc_id"]: r["n_removed"] for r in got if (r["doc_id"] or 0) >= 2000} == {2000: 0, **{2001 + i: 2 for i in range(5)}, 2100: 2, 2101: 3}
    # Spared are whole copies, and nothing else.
    spared = {r["doc_id"]: len(r["removed"]) for r in lines.removals(lines.texts(table(spark, some)), None, True).collect()}
    assert (spared[2001], spared[2100], spared[2101]) == (2, 2, 0)


def test_query_removes_every_repeated_line(spark, tmp_path):
    head = "the head of every page of that site, longer than what follows"
    rows = [(i, f"{head}\nown {i ** 9}", "en", "s", 1) for i in range(4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_repeated"], r["n_removed"]) for r in got} == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (1, 1)}


def test_lines_of_all_rows(docs, rows, no_docs):
    got = lines.dedup_lines(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert {r["text"] for r in got if r["doc_id"] == 400} == {t for i, t in rows if i == 400}
    assert lines.dedup_lines(no_docs).collect() == []


def test_word_places_do_not_depend_on_batches():
    import pyarrow as pa

    texts = pa.array(["Ab  c", None, "", "é x1-y", "z" * 3000, " b"])
    whole = W.words(texts, W.LETTERS, True)
    hashes = W.word_hashes(whole)
    for i in range(len(texts)):
        one = W.words(texts.slice(i, 1), W.LETTERS, True)
        assert (W.word_hashes(one) == hashes[whole.first[i] : whole.first[i + 1]]).all()
    assert [bytes(whole.data[s:e]).decode()[:2] for s, e in zip(whole.start, whole.end, strict=True)] == ["ab", "c", "é", "x1", "y", "zz", "b"]
    assert len(set(hashes.tolist())) == 7
