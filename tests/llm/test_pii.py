import hashlib
import random
import re

import numpy as np

from lithoframe.llm import pii, pii_model

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def expected(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and pii_model.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "plain words", "a@b@c.d and x.y@z.com, q@w", "a@b.c_d@e.f.g..h@i.j", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.1.1 1.2.3",
    "4207051279108084 4207 0512 7910 8084 4207-0512-7910-8085 1234", "+1 (434) 555-2368 +12 +1 ((( 5 +49 30 1234567.", "éàü ✓😀 me@x.org 😀 10.0.0.1 ß+33 1 23 45 67 89",
    "9" * 30000, "a" * 50000 + "@", "1 " * 20000, "x@y.z " * 3000, "+" + "1 (" * 5000, "write to joe.doe (at) mail (dot) com or phone: (212) 555-1234 now", "version 2019-123-4567 and ISBN 123.456.789",
]


def test_base_spans_match_plain_regular_expressions(docs_of):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    got = pii.pii_digest(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = expected(TEXTS[r.doc_id] or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))


def test_method_adds_unusual_formats_and_leaves_lookalikes(docs_of):
    got = {r.doc_id: r.spans for r in pii.pii_digest(docs_of(list(enumerate(TEXTS)))).collect()}
    assert got[14].count("email") == 1 and got[14].count("phone") == 1
    assert got[15] == "" and got[2] == "" and got[0] == ""


def test_every_made_up_format_is_proposed_and_most_are_found(docs_of):
    r = random.Random(77)
    good, _ = pii_model.templates(r)
    rows, want = [], {}
    for kind, makers in enumerate(good):
        for make in makers:
            for _ in range(12):
                span, i = make(), len(rows)
                lead = f"so {r.choice(pii_model.HINTS[kind])}"
                rows.append((i, f"{lead}{span} and more"))
                want[i] = (kind, f"{pii_model.PROPOSED_KINDS[kind]}:{len(lead)}:{len(lead) + len(span)}")
    got = {x.doc_id: set(x.spans.split(",")) for x in pii.pii_digest(docs_of(rows)).collect()}
    found = {k: np.mean([w in got[i] for i, (kind, w) in want.items() if kind == k]) for k in range(len(good))}
    assert min(found.values()) >= 0.9, found


def test_redaction(docs_of):
    got = {r.doc_id: r.text for r in pii.redact(docs_of([(0, "Mail me@x.org, call +1 (434) 555-2368."), (1, None), (2, "none"), (3, 'token = "0123456789abcdef0123456789abcdef01234567".')])).collect()}
    assert got == {0: "Mail [EMAIL], call [PHONE].", 1: "", 2: "none", 3: 'token = "[SECRET]".'}


def test_held_out_accuracy_and_columns_equal_the_python_features(docs_of):
    fit = pii_model.fitted()
    assert fit["precision"] >= 0.98 and min(fit["recall"].values()) >= 0.9, fit["recall"]
    from pyspark.sql import functions as F

    text = "call me at (212) 555-1234, order 4207.0512.7910.8084!"
    df = docs_of([(0, text)])
    spans = [(11, 3, 25), (33, 2, 52)]
    for a, k, b in spans:
        s = F.struct(F.lit(a).alias("start"), F.lit(k).alias("kind"), F.lit(b).alias("end"), F.lit(text[a:b]).alias("hit"))
        x = df.select(F.array(*pii.features(F.col("text"), s)).alias("x")).first().x
        assert x == pii_model.features(k, text[a:b], text[:a], text[b:])
        score = df.select(pii._score(F.array(*map(F.lit, x)), fit["trees"]).alias("s")).first().s
        assert abs(score - pii_model.predict(fit["trees"], np.array([x]))[0]) < 1e-9


def test_empty_table(docs_of):
    assert pii.pii_digest(docs_of([])).count() == 0


def test_a_span_beaten_by_a_beaten_one_stays(spark):
    from pyspark.sql import functions as F

    scored = "array<struct<score:double,span:struct<start:int,kind:int,end:int,hit:string>>>"
    rows = [([(0.9, (0, 1, 10, "a")), (0.8, (5, 1, 15, "b")), (0.7, (12, 1, 20, "c")), (0.7, (12, 0, 19, "d")), (0.1, (30, 0, 31, "e"))],), ([],)]
    got = [[s.hit for s in r.k] for r in spark.createDataFrame(rows, f"m {scored}").select(pii.best(F.col("m")).alias("k")).collect()]
    assert got == [["a", "d", "e"], []]


def test_every_text_with_a_match_passes_the_cheaper_tests(docs_of):
    r = random.Random(7)
    good, bad = pii_model.templates(r)
    texts = [f"x {make()} y" for makers in [*good, *bad] for make in (makers if isinstance(makers, (list, tuple)) else [makers]) for _ in range(20)] + [t for t in TEXTS if t and len(t) < 5000]
    held = lambda t, rows: all(any(bool(re.search(pii.DIGITS.replace("}+", "}"), t)) if p == "DIGITS" else p in t for p in row) for row in rows)
    loose = lambda p: p.replace("}+", "}").replace("++", "+").replace("*+", "*")
    for t in texts:
        for i, (_, pattern, _) in enumerate(pii.PROPOSED[:7]):
            assert held(t, pii.HOLDS[i]) or not re.search(loose(pattern), t), (i, t)
        for k, pattern in PLAIN.items():
            assert held(t, pii.HOLDS[k]) or not [m for m in expected(t) if pii.KINDS[m[1]] == k], (k, t)


def test_secrets_are_among_the_spans(docs_of):
    (r,) = pii.pii_digest(docs_of([(1, 'mail a@b.org and token = "0123456789abcdef0123456789abcdef01234567" end')])).collect()
    assert r.spans == "email:5:12,secret:26:66" and r.secrets == "secret:26:66" and r.n_found == 2
