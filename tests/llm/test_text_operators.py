"""Quality rules, line dedup, near-dedup and mixing on small fixtures, odd rows included."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import DOCS, ODD, prose

from lorekeep.llm import line_dedup, mixing, near_dedup, quality_rules
from lorekeep.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("words", "row", "size", "start", "a", "b", "block", "slot", "hashes")


def measured(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_rules_against_brute_force(documents):
    texts = [t for _, t in ODD] + ["a b c a b c", "a a a a a", "x\nx\n\n x\nx", "p q r s " * 90, prose(3, 200) + " " + prose(3, 100), "# * é <b> | " * 20,
                                   " ".join(f"w{i % 150}" for i in range(900))]
    docs = documents(list(enumerate(texts)), *CLASHES)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, [0.0] * quality_rules.BUCKETS, -1.0).collect()}
    for i, text in enumerate(texts):
        r, want = got[i], measured(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_ratio_prefers_what_trusted_documents_look_like(spark, documents):
    rows = [(i, prose(0, 40) + " " + prose(i, 30)) for i in range(30)] + [(100 + i, prose(0, 10) + " $$ ".join(["junk"] * 60)) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 30, 2)] + [(100, 0), (0, 1), (None, 1)], "doc_id long, quality int")
    docs = documents(rows)
    got = {r["doc_id"]: r["llr"] for r in quality_rules.judge(docs, *quality_rules.fit(docs, quality_rules.trusted_ids(labels))).collect()}
    assert min(v for k, v in got.items() if k < 100) > max(v for k, v in got.items() if k >= 100)


def test_quality_without_rows_or_labels(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(docs, *quality_rules.fit(docs, quality_rules.trusted_ids(labels))).count() == 0


def dedup_by_hand(rows):
    first, gone = {}, collections.defaultdict(set)
    for place, (doc_id, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        lines = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((text or "").split("\n"))]
        full = [x for x in lines if x[1]]
        for (a, x), (_, y), (c, z) in zip(full, full[1:], full[2:]):
            if (x, y, z) not in first:
                first[x, y, z] = (place, c)
                continue
            own, end = first[x, y, z]
            gone[place] |= {i for i in range(a, c + 1) if own != place or i > end}
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, (_, t) in enumerate(rows)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", " a ", "", "c", "d"]), max_size=12), min_size=1, max_size=6))
def test_line_windows_against_brute_force(documents, texts):
    rows = [(i // 2, "\n".join(t)) for i, t in enumerate(texts)]
    got = line_dedup.dedup_lines(documents(rows)).select("doc_id", "text").collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((r[0], t) for r, t in zip(rows, dedup_by_hand(rows)))


def test_line_windows_odd_rows_and_clashing_columns(spark, documents):
    rows = [*ODD, (7, "p\nq\nr\ns"), (8, "z\np\nq\n\nr\ny"), (9, "\n".join(["k"] * 3000))]
    got = line_dedup.dedup_lines(documents(rows, *CLASHES))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted((r[0] or 0, t or "") for r, t in zip(rows, dedup_by_hand(rows)))
    assert got.where("doc_id = 8").first()["text"] == "z\ny" and got.where("doc_id = 1").first()["text"] is None
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def labelled_shingles(text):
    w, seen, out = WORD.findall(text), collections.Counter(), []
    for k in range(max(1, len(w) - 4)):
        g = tuple(w[k:k + 5])
        seen[g] += 1
        out.append((g, seen[g]))
    return out


def ordered(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1] / (len(a) + len(b) - best[-1, -1])


def changed(text, places):
    w = text.split()
    for p in places:
        w[p] = "changed" + str(p)
    return " ".join(w)


def test_near_classes_against_brute_force(documents):
    base = prose(50, 120)
    rows = [(1, base), (2, changed(base, [10])), (3, changed(base, [60, 61])), (4, prose(51, 120)), (5, base + "  "), (6, changed(base, range(0, 120, 7))),
            (7, prose(50, 60) + " " + prose(52, 60)), (8, "a b c"), (9, "a b c"), (10, "a b d"), (11, " ".join(reversed(base.split()))), *[(20 + i, t) for i, (_, t) in enumerate(ODD)]]
    rows += [(100 + i, changed(base, [5 + 2 * i, 40 + i])) for i in range(30)]
    class_of = {i: i for i, _ in rows}

    def root(x):
        while class_of[x] != x:
            x = class_of[x]
        return x

    parts = {i: labelled_shingles(t) if t and t.strip() else None for i, t in rows}
    for i, _ in rows:
        for j, _ in rows:
            if i < j and parts[i] and parts[j] and ordered(parts[i], parts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                class_of[b] = a
    got = {r["id"]: (r["class_id"], r["class_size"]) for r in near_dedup.near_classes(documents(rows, *CLASHES)).collect()}
    sizes = collections.Counter(root(i) for i, _ in rows)
    assert got == {i: (root(i), sizes[root(i)]) for i, _ in rows}


def test_centre_less_group_keeps_every_link(documents):
    """A chain: neighbours are alike, ends are not, so one centre cannot hold the group."""
    base = prose(60, 150)
    rows = [(i, changed(base, range(0, i * 2))) for i in range(25)]
    got = near_dedup.near_classes(documents(rows)).collect()
    assert {r["class_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_near_dedup_odd_rows(spark, documents):
    kept = near_dedup.drop_near_duplicates(documents(ODD))
    assert kept.count() == len(ODD) - 1 and kept.columns == DOCS.names
    assert near_dedup.near_classes(spark.createDataFrame([], DOCS)).count() == 0


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_alignment_is_the_longest_common_subsequence(a, b):
    x, y = near_dedup.shingles(np.array(a, np.int64)), near_dedup.shingles(np.array(b, np.int64))
    if len(x) and len(y):
        want = ordered(x.tolist(), y.tolist())
        assert near_dedup.similarity(x, y) == pytest.approx(want if want >= 0.8 else 0.0)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (7, 7), (5, 4)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(21)}


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", "é", None]), st.integers(0, 60)), min_size=1, max_size=25))
def test_targets_are_the_repeated_resharing(spark, rows):
    sizes = collections.Counter()
    for s, n in rows:
        sizes[s] += n
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == targets_by_hand(sizes)


def test_mix_follows_targets_and_schedule(spark, documents):
    rows = [(i, prose(i, 5 + i % 40), "abcde"[i % 5] if i % 7 else None) for i in range(120)] + [(None, "x y", "a"), (3, None, "zz"), (3, "", "a"), (4, "t u v", "b"), (4, "t u v", "b")]
    mix = mixing.Mix(documents(rows))
    taken = mix.taken().collect()
    assert len(taken) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in taken)
    by_source = collections.Counter()
    for r, t in zip(mix.documents().collect(), [None] * len(rows)):
        by_source[r["source"]] = r["target"]
    got = collections.Counter()
    pieces = mix.pieces().where("slot is not null").collect()
    for p in pieces:
        got[p["source"]] += p["length"]
    assert all(abs(got[s] - t) <= 1 for s, t in by_source.items())
    slots = sorted((r["source"] or "", r["slot"], r["block"]) for r in mix.slots().collect())
    per = collections.defaultdict(list)
    for s, _, b in slots:
        per[s].append(b)
    assert all(b == list(range(len(b))) for b in per.values()) and len({x[1] for x in slots}) == len(slots)
    # Every stretch of the schedule has each source's share, give or take a few slots.
    n, total = len(slots) // 4, collections.Counter(s for s, _, _ in slots)
    early = collections.Counter(s for s, _, _ in sorted(slots, key=lambda x: x[1])[:n])
    assert all(abs(early[s] - total[s] / 4) <= 6 for s in total)
    assert mixing.mix_documents(documents(rows)).columns == DOCS.names
    assert mixing.Mix(spark.createDataFrame([], DOCS)).taken().count() == 0
