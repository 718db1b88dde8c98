from collections import Counter, defaultdict

from sparkloom.llm import line_dedup

from .conftest import ODD


def by_hand(rows, ratio, least):
    pages, counts = Counter(), defaultdict(Counter)
    for _, text, host in rows:
        pages[host] += 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} if text is not None else ():
            counts[host][line] += 1
    out = []
    for i, text, host in rows:
        bad = {x for x, n in counts[host].items() if x and n >= least and n > ratio * pages[host]}
        out.append((i, host, text if text is None else "\n".join(x for x in text.split("\n") if x.strip(" \t\r") not in bad)))
    return Counter(out)


def test_against_brute_force(spark, make):
    rows = [(i, "\n".join(["head" if i % 3 else " head ", f"line {i}", "", "foot" if i % 11 == 0 else "", f"tail {i % 2}"]), f"h{i % 4}" if i % 5 else None) for i in range(120)]
    for ratio in (0.1, 0.4):
        for most in (0, 1000):
            got = line_dedup.dedup_lines(make(rows), ratio=ratio, min_pages=3, broadcast_lines=most)
            assert Counter((r.doc_id, r.source, r.text) for r in got.collect()) == by_hand(rows, ratio, 3)


def test_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd, dropped="n_dropped")
    assert got.columns == [*odd.columns, "n_dropped"]
    assert Counter((r.doc_id, r.source, r.text) for r in got.collect()) == by_hand(ODD, 0.1, 3)
    assert line_dedup.dedup_lines(none).count() == 0
