"""The pipeline's stages on a small table, each against brute force over its own input."""

import collections
import random
import re

import corpus_pipeline as C
from hourloom.llm import pieces

from .test_llm import _docs, _texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts_of_all_kinds():
    rng = random.Random(12)
    base = [rng.choice("abcdefgh") + str(k) for k in range(90)]
    near = [" ".join(base), " ".join([*base[:44], "other", *base[44:]]), " ".join([*base, "end"])]
    return [*_texts(), "junk " * 60, *near]


def _passes(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    repeated = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(words) >= 20 and 100 * len(repeated) <= 30 * len(words)


def _lines_left(texts):
    """{id: text} after template line dedup."""
    mask = lambda w: "*" if re.search(r"[0-9@]|://", w) else w
    lines = {(i, k): tuple(map(mask, WORD.findall(x))) for i, t in sorted(texts.items()) for k, x in enumerate((t or "").split("\n"))}
    leaders, docs = {}, collections.defaultdict(set)
    name = {}
    for (i, _), line in lines.items():
        if line and line not in name:
            leaf = leaders.setdefault((len(line), line[:3]), [])
            alike = [x for x in leaf if 100 * sum(a == b for a, b in zip(x, line)) >= 70 * len(line)]
            name[line] = alike[0] if alike else line
            leaf.extend([] if alike else [line])
        if line:
            docs[name[line]].add(i)
    gone = {(i, k) for (i, k), line in lines.items() if line and i != min(docs[name[line]])}
    left = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    return {i: t for i, t in left.items() if WORD.search(t) or not WORD.search(texts[i] or "")}


def _firsts(texts):
    """Ids that stay after near dedup."""
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_stages(spark, tmp_path):
    texts = _texts_of_all_kinds()
    docs = _docs(spark, texts).selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = [docs]
    for k, (name, stage) in enumerate(C.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, seen[-1], str(tmp_path)).write.parquet(path)
        seen.append(spark.read.parquet(path))
    for df in seen[1:-1]:
        assert df.columns == C.COLUMNS
    held = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in seen[:-1]]
    assert held[1] == {i: t for i, t in held[0].items() if _passes(t)}  # all labels are good, so the rules alone decide
    assert held[2] == _lines_left(held[1]) and len(held[2]) < len(held[1])
    assert all(WORD.search(t) for t in held[2].values())
    assert all(r.n_chars == len(r.text) for r in seen[2].collect())
    assert held[3] == {i: held[2][i] for i in _firsts(held[2])} and len(held[2]) - len(held[3]) >= 2
    assert held[4] == held[3]
    last = seen[5].collect()
    assert {r.doc_id: r.text for r in pieces.decode_pieces(seen[5]).collect()} == held[4] and all(r.lossless for r in last)
    # The order written by the mixing stage is the order that the last stage states.
    files = seen[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    written = [r.doc_id for r in sorted(files, key=lambda r: (r.file_name, r.row_index))]
    assert written == [r.doc_id for r in sorted(last, key=lambda r: (r.slot, r.place))]
    assert len({(r.slot, r.place) for r in last}) == len(last) and all(len({x.source for x in last if x.slot == r.slot}) == 1 for r in last)
