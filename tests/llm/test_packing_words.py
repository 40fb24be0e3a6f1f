"""Words of letters, with or without a sign behind them, need no search by the pattern."""

from pulseframe.llm import packing


def test_plain_words_are_not_searched():
    words = packing.Words(packing.vocabulary_path())
    texts = ["Haanth. Échaile thndenwh, it's x2 ½a ªb! don't", "zz\x01q a-b ß? İx. 中文, ét;"]
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    searched, cut = [], words.cut
    words.cut = lambda w: searched.append(w) or cut(w)
    ids, off = words.encode([t.encode() for t in texts])
    assert [ids[a:z].tolist() for a, z in zip(off[:-1], off[1:], strict=True)] == want
    assert searched and not {"haanth.", "échaile", "thndenwh,", "ªb!", "ß?"} & set(searched)
