"""The pipeline over the smallest tables."""

import collections
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    n = docs.count()
    from surveyloom.llm.shared import stored

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf), name)
        if k < 4:
            assert docs.columns == names
            assert 0 < docs.count() <= n
            n = docs.count()
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert len(kept) == n
    bench = [r[0] for r in duckdb.connect().execute(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    flat = lambda t: " ".join(t.lower().split())
    leaks = {i for i, t in rows if any(flat(b) in flat(t) for b in bench)}
    assert not leaks & kept


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def passes_base(t):
    w = words(t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w) >= 50 and 100 * len(again) <= 50 * len(w)


def without_common_lines(docs):
    """Stage 1 in plain Python: {id: text} of the rows that stay."""
    flat = lambda line: " ".join(words(line.lower()))
    lines = {i: frozenset(flat(x) for x in (t or "").split("\n") if words(x)) for i, (t, _) in docs.items()}
    hosts = collections.defaultdict(set)
    for i, (_, h) in docs.items():
        hosts[h].add(lines[i])
    often = {h: {x for x in set().union(*sets) if sum(x in s for s in sets) > max(5, 0.03 * len(sets))} for h, sets in hosts.items()}
    out = {}
    for i, (t, h) in docs.items():
        if passes_base(t):
            left = "\n".join(x for x in t.split("\n") if flat(x) not in often[h] or not words(x))
            if 100 * len(words(left)) >= 40 * len(words(t)):
                out[i] = left
    return out


def one_of_each_group(docs):
    """Stage 2: documents without an earlier one that links reach."""
    sets = {i: {tuple(words(t.lower())[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} for i, t in docs.items()}
    up = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = {k: a if v == b else v for k, v in up.items()}
    return {i: t for i, t in docs.items() if up[i] == i}


def test_run_equals_plain_python(spark, tmp_path):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    rng = random.Random(13)
    prose = lambda n: " ".join(f"{rng.choice(['garden', 'river', 'table'])}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    item, menu = prose(30), [prose(25) for _ in range(3)]
    texts = [prose(80) for _ in range(30)]
    near = texts[0].split()
    near[40] = "changed"
    texts += [" ".join(near), texts[1], prose(30), "again and again " * 40, None, "", prose(40) + " " + item.upper() + ". " + prose(40)]
    texts += ["\n".join([*menu, prose(90)]) for _ in range(8)] + ["\n".join([*menu, prose(5)])]
    texts += [prose(60) + " password=Kq82xZw91pLm " + prose(20), prose(2500)]
    docs = {i: (t, f"host{i % 2 if i < 37 else 0}") for i, t in enumerate(texts)}
    spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, (t, h) in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = one_of_each_group(without_common_lines(docs))
    want = {i: t.replace("Kq82xZw91pLm", "[SECRET]") for i, t in want.items() if item not in t.lower()}
    assert len(want) == 40 and all(m not in t for t in want.values() for m in menu)
    tokens = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    ids = {i: [*tokens.encode(t, add_special_tokens=False).ids, 1] for i, t in want.items()}
    rows, seen, places = corpus_pipeline.run(spark, str(tmp_path)).collect(), collections.Counter(), collections.defaultdict(list)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for x in places.values():
        ends = np.cumsum([n for _, n in sorted(x)])
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0
