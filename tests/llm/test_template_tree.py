"""Lines of one template whose variable words lie in several places, or in short lines, against brute force."""

import random

from hourloom.llm import templates

from .test_llm import _docs


def test_two_fields_vary(spark):
    texts = ["user anna logged in from the north gate today", "user bert logged in from the south gate today", "user carl logged out of it all by night now"]
    got = {r.doc_id: r.n_dropped for r in templates.drop_template_lines(_docs(spark, ["a b c d " + t for t in texts])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_short_line(spark):
    got = {r.doc_id: r.n_dropped for r in templates.drop_template_lines(_docs(spark, ["job ended with success", "job ended with failure", "job ended with all of it"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_leaders_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["a b c " + " ".join(rng.choice("xyz") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    alike = lambda a, b: len(a) == len(b) and 100 * sum(x == y for x, y in zip(a, b)) >= 70 * len(a)
    leaders, gone = [], set()
    for i, t in enumerate(texts):
        if any(alike(t.split(), leader) for leader in leaders):
            gone.add(i)
        else:
            leaders.append(t.split())
    got = {r.doc_id for r in templates.drop_template_lines(_docs(spark, texts)).where("n_dropped > 0").collect()}
    assert got == gone and len({texts[i] for i in gone} - {t for i, t in enumerate(texts) if i not in gone}) > 20
