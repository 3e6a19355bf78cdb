import random
import re

import numpy as np
import pytest

from lithoframe.llm import pieces

TEXTS = [
    None, "", " ", "   ", "Hello  world\n a\tb  ", "a" * 5000, "▁x ▁▁ y", "é ﬁ 😀 \n\n\x00 ß", "ab" * 40 + " cd", " lead and trail \n", "The quick brown fox, 12,345 times!", "ñandú übermäßig çà et là",
]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model()


def test_without_dropout_it_is_the_model_itself(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coder = pieces.Coder(model, 0.0)
    r = random.Random(3)
    made = ["".join(r.choice("abcde  \n.,éßAB12") for _ in range(r.randint(1, 300))) for _ in range(300)]
    for t in TEXTS + made:
        if t and "▁" not in t:
            assert coder.encode(t).tolist() == sp.encode(t), repr(t)


def test_dropout_is_lossless_varied_and_repeatable(model):
    plain, a, b, other = (pieces.Coder(model, p, s) for p, s in ((0.0, 1), (0.3, 1), (0.3, 1), (0.3, 2)))
    text = "internationalisation of representative tokenisations " * 200
    x = a.encode(text, a.start(7))
    assert x.tolist() == b.encode(text, b.start(7)).tolist() != other.encode(text, other.start(7)).tolist() and x.tolist() != a.encode(text, a.start(8)).tolist()
    assert len(x) > len(plain.encode(text)) and a.decode(x) == text
    split = "\0".join(a.surfaces(np.array([i])).decode() for i in x.tolist())
    assert len({w for w in re.split("\0(?= )", split) if w.replace("\0", "") == " representative"}) > 8


def test_list_and_heap_agree(model):
    r = random.Random(4)
    for _ in range(300):
        chars = [r.choice("theranoing▁") for _ in range(r.randint(1, 60))]
        for limit in (0, 2**30, 2**32):
            assert pieces.segment_short(chars, model["rank"], 99, limit) == pieces.segment_long(chars, model["rank"], 99, limit)
    assert pieces.segment_short(list("there"), model["rank"], 99, 2**32) == list("there")


def plainly(model, text, start, limit):
    """The ids of a text by one list for each unit."""
    size, out = model["size"], []
    for k, unit in enumerate(re.findall(r" *[^ \n]+| +|\n", " " + text)):
        chars = ["\0" + c if c == pieces.SPACE else pieces.SPACE if c == " " else c for c in unit]
        key = int(pieces.unit_keys(np.array([start]), np.array([k]))[0])
        for p in pieces.segment_short(chars, model["rank"], key, limit):
            i = model["pieces"].get(p)
            out += [model["bytes"][b] for b in p.removeprefix("\0" if len(p) > 1 else "").encode("utf-8", "surrogatepass")] if i is None else [i]
    assert size > max(out)
    return out


def test_arrays_equal_a_list_for_each_unit(model):
    r = random.Random(8)
    texts = [t for t in TEXTS if t] + ["".join(r.choice("theranoing \n.,éßAB12▁😀") for _ in range(r.randint(1, 400))) for _ in range(200)]
    for p in (0.0, 0.1, 0.5, 1.0):
        coder = pieces.Coder(model, p)
        starts = [r.randrange(2**32) for _ in texts]
        ids, at = coder.encode_many([None, *texts, ""], [0, *starts, 0])
        assert [ids[a:b].tolist() for a, b in zip(at[1:-2], at[2:-1])] == [plainly(model, t, s, coder.limit) for t, s in zip(texts, starts)]
        assert at[0] == at[1] and at[-1] == at[-2] == len(ids)
        assert coder.lossless([None, *texts, ""], ids, at) == [True] * (len(texts) + 2)


def test_what_does_not_come_back_is_told(model):
    coder = pieces.Coder(model, 0.0)
    ids, at = coder.encode_many(["ab cd", "ef"], [1, 2])
    assert coder.lossless(["ab cd", "eg"], ids, at) == [True, False] and coder.lossless(["ab c", "d ef"], ids, at) == [False, False]


def test_round_trip_of_a_table(docs_of):
    rows = [*enumerate(TEXTS), (None, "no id"), (4, TEXTS[4])]
    got = pieces.encode(docs_of(rows))
    out = got.collect()
    assert len(out) == len(rows) and all(r.lossless and r.n_tokens == len(r.ids) for r in out)
    back = {r.doc_id: r.text for r in pieces.decode(got).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert pieces.encode(docs_of([])).count() == 0
