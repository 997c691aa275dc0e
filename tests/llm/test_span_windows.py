"""Repeated passages against brute force on 51-word windows: with few whole sentences, and cut at both ends."""

from hourloom.llm import sentence_spans

from .test_llm import _docs


def _sentence(name, n):
    return " ".join([f"{name}{k}" for k in range(n - 1)] + [f"{name}end."])


def test_passages_of_few_whole_sentences(spark):
    middle = {"one": _sentence("m", 26), "two": _sentence("p", 9) + " " + _sentence("q", 9)}
    for kind, whole in middle.items():
        head, tail = " ".join(f"h{k}" for k in range(20)) + ".", " ".join(f"t{k}" for k in range(25))
        texts = [f"{_sentence(c, 7)[:-1]} {head} {whole} {tail} {c}x {c}y." for c in "ab"]
        words = [t.split() for t in texts]
        windows = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in words]
        assert windows[0] & windows[1]  # both documents have a passage of 51 words
        got = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(_docs(spark, texts)).collect()}
        assert got[0].text == texts[0] and whole not in got[1].text, kind
        assert got[1].text.startswith("b0")


def test_single_sentences_below_the_limit_stay(spark):
    alone = _sentence("m", 24)
    texts = [f"{_sentence(c, 7)} {alone} {_sentence(c + c, 9)}" for c in "ab"]
    assert [r.n_removed for r in sentence_spans.remove_repeated_spans(_docs(spark, texts)).collect()] == [0, 0]
    shorter = {r.doc_id: r.n_removed for r in sentence_spans.remove_repeated_spans(_docs(spark, texts), long_words=24).collect()}
    assert shorter == {0: 0, 1: 1}


def test_passage_inside_a_sentence_is_out_of_reach(spark):
    inside = " ".join(f"i{k}" for k in range(60))
    texts = [f"a b {inside} c d.", f"e f {inside} g h."]
    got = sentence_spans.remove_repeated_spans(_docs(spark, texts)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 0}
