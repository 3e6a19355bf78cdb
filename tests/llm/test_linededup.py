import hashlib
import re

from lithoframe.llm import linededup

LINE = "this line stands in very many documents"


def brute(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            if i is not None and t is not None:
                holders.setdefault(key(s), set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if i is None or last.get(key(s), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(i, f"own {i}\n {LINE.upper()}\t\nrest {i % 3} of the text that repeats a lot") for i in range(40)] + [
    (100, None), (101, ""), (102, "\n"), (103, f"{LINE}\n{LINE}\r\n\n{LINE}"), (103, f"another text of this id\n{LINE}"), (104, "x" * 19 + "\n" + "y" * 20), (105, "y" * 20 + "\n" + "x" * 19), (106, "Y" * 20 + "\nÀ line with accents kept é"),
    (107, "à line with accents kept é"), (108, "À line with accents kept é\n" + LINE), (None, LINE), (109, "\n".join([LINE, "z"] * 3000)),
]


def test_digest_equals_brute_force(docs_of):
    got = linededup.line_digest(docs_of(ROWS)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str) == brute(ROWS)


def test_bitmaps_hold_what_stays(docs_of):
    for few in (0, 10**6):
        found = linededup.keep_bitmaps(docs_of(ROWS), broadcast_rows=few).collect()
        want = {r[:2] + r[3:]: r[2] for r in brute(ROWS) if r[2]}
        texts = {}
        for r in found:
            assert r.keep_runs[0].start == 0 and [x.stop is None for x in r.keep_runs] == [False] * (len(r.keep_runs) - 1) + [True]
            assert all(a.stop < b.start for a, b in zip(r.keep_runs, r.keep_runs[1:]))
            for i, t in ROWS:
                if i == r.doc_id and t:
                    lines = t.split("\n")
                    kept = [s for x in r.keep_runs for s in lines[x.start : len(lines) if x.stop is None else x.stop]]
                    key = (i, len(lines), hashlib.sha256("\n".join(kept).encode()).hexdigest())
                    if want.get(key) == len(lines) - len(kept):
                        texts[key] = want[key]
        assert texts == want and len(found) == len(want)


def test_columns_stay_and_empty(docs_of):
    df = docs_of(ROWS)
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(ROWS) and linededup.line_digest(docs_of([])).count() == 0
