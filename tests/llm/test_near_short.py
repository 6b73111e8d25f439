"""Near duplicates among short texts: every length, at similarities from 0.8 on, none by chance."""

from llm_rows import prose

from lorekeep.llm import near_dedup


def test_no_short_pair_at_the_limit_is_missed(documents):
    rows, want = [], {}
    for n in range(4, 41):  # shingles: n + 4 words
        least = -(-n * 4 // 5)
        for k in range(4):  # of n shingles the longer has, the shorter lacks some at one end or at both
            cut = (n - least) if k < 3 else 1
            text, id_ = prose(1000 * n + k, n + 4).split(), 100 * n + 2 * k
            front = (0, cut, cut // 2, 0)[k]
            rows += [(id_, " ".join(text)), (id_ + 1, " ".join(text[front:len(text) - (cut - front)]))]
            want |= {id_: id_, id_ + 1: id_ if (n - cut) * 5 >= n * 4 else id_ + 1}
    got = {r["id"]: r["class_id"] for r in near_dedup.near_classes(documents(rows)).collect()}
    assert {i: got[i] for i in want if got[i] != want[i]} == {}


def test_short_texts_of_common_shingles(documents):
    """A line that all texts share fills no prefix it need not: those alike are found, others stay apart."""
    line = prose(1, 30)
    rows = [(i, line + " " + prose(50 + i // 2, 12) + (" more" if i % 2 else "")) for i in range(60)]
    got = {r["id"]: r["class_id"] for r in near_dedup.near_classes(documents(rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
