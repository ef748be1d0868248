"""Byte-pair encoding, conversation repair and whitening against other libraries and brute force."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import op12_repair as repair
from surveyloom.llm.op11_bpe import Bpe, RankQueue, decode, encode, round_trip
from surveyloom.llm.op13_whitening import Spectrum, rank_one, spectra, whiten

files = pytest.importorskip("public_tokenizers")
RANKS = files.path("byte_bpe_multi_50k.tiktoken")
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward_texts():
    rng = random.Random(5)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    out = [None, "", " ", "\n", "  a", "a  b", "a \n b", "a\n\nb c", " a b", "a b ", "　x\x85 y", "<|endoftext|> I'll we've", "\U0001f600" * 9, "a\x00b"]
    out += [some("ab", 3000), "a" * 5000, some("abcdeé中ñ", 4000), some("ab \n\t.,1é", 4000), " " * 3000 + "x", some("the in on", 9000)]
    return out + [some("abcdefghij ", rng.randrange(1, 300)) for _ in range(150)]


def test_bpe_equals_the_library(spark, library):
    texts = awkward_texts()
    rows = [(None if k == 3 else k, t, "x") for k, t in enumerate(texts)] + [(7, texts[7], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = encode(df, RANKS, files.PATTERN)
    want = sorted((-1 if i is None else i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got.collect()) == want
    back = {r.doc_id: bytes(r.decoded).decode() for r in decode(got, RANKS, files.PATTERN).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    hashed = {r.doc_id: r for r in round_trip(df, RANKS, files.PATTERN).collect()}
    for i, t, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert (hashed[i].n_tokens, hashed[i].ids_sha256, hashed[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert round_trip(df.limit(0), RANKS, files.PATTERN).count() == 0


def test_bpe_forgets_and_goes_in_portions(library, monkeypatch):
    monkeypatch.setattr("surveyloom.llm.op11_bpe.REMEMBERED", 3)
    monkeypatch.setattr("surveyloom.llm.op11_bpe.PORTION", 50)
    monkeypatch.setattr("surveyloom.llm.op11_bpe.WIDE", 2)
    bpe, texts = Bpe(RANKS, files.PATTERN), [t or "" for t in awkward_texts()]
    for _ in range(2):
        got = defaultdict(bytes)
        for k, ids in bpe.encode(texts):
            got[k] += ids
        assert [np.frombuffer(got[k], "<u4").tolist() for k in range(len(texts))] == [library.encode_ordinary(t) for t in texts]
        assert [bpe.decode(got[k]).decode() for k in range(len(texts))] == texts
    assert not bpe.queue.buckets and not any(map(any, bpe.queue.levels))


def test_rank_queue():
    rng, queue, held = random.Random(2), RankQueue(70_000), defaultdict(set)
    pair = np.full(1000, -1)
    for _ in range(3000):
        if rng.random() < 0.5:
            r, i = rng.randrange(70_000) if rng.random() < 0.7 else 7, rng.randrange(1000)
            held[r].add(i)
            queue.push(r, i)
        elif held:
            low = min(held)
            pair[:] = low
            assert queue.lowest() == low and sorted(set(np.array(queue.take(low, pair)).tolist())) == sorted(held.pop(low))
    while held:
        assert queue.lowest() == min(held)
        held.pop(queue.lowest())
        queue.take(queue.lowest(), pair)
    assert queue.lowest() == -1


# ---- conversation repair


def brute(rows):
    """(cost, audit) of the best repair by trying all, with up to two inserts before each row and at the end."""
    best = None
    legal = re.compile(r"(s?(ua)+)?\Z")

    def go(i, out, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            for n in range(3):
                for roles in itertools.product("ua", repeat=n):
                    if legal.match(out + "".join(roles)):
                        best = min(best or (cost + 2 * n, audit + "I" * n), (cost + 2 * n, audit + "I" * n))
            return
        initial, fault = rows[i]
        for n in range(3):
            for roles in itertools.product("ua", repeat=n):
                now, c, a = out + "".join(roles), cost + 2 * n, audit + "I" * n
                go(i + 1, now, c + 3, a + "D")
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    go(i + 1, now + (initial or "?"), c + more, a + "K")
                    for r in "ua":
                        go(i + 1, now + r, c + 2 + more, a + "R")

    go(0, "", 0, "")
    return best


def letter(initial, fault):
    if fault in ("blank", "duplicate"):
        return "x"
    role = initial if initial in ("s", "u", "a") else "o"
    return role.upper() if fault else role


@pytest.mark.parametrize("seed", range(60))
def test_lightest_repair_equals_all_tried(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suuaat"), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(5))]
    text = "".join(letter(*r) for r in rows)
    want = brute(rows)
    assert repair.best(repair.solve_rows(text)) == want
    for cut in (1, 2, 3):
        charts = [list(repair.solve_rows(text[k : k + cut])) for k in range(0, len(text), cut)] or [list(repair.solve_rows(""))]
        assert repair.best(repair.join_runs(charts)) == want


def plain(conversations):
    """The whole query in plain Python; the repair by dynamic programming from the end."""
    groups, out = defaultdict(list), {}
    for conv, turn, role, text in conversations:
        groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        n, far = len(rows), (10**9, "")
        rest = {(n, s): w for s, w in {"": (0, ""), "s": (4, "II"), "u": (2, "I"), "a": (0, "")}.items()}
        for i in range(n - 1, -1, -1):
            def step(state, i=i):
                want, kind = "a" if state == "u" else "u", faults[i]
                ways = [(3, "D", state)]
                if kind not in ("blank", "duplicate"):
                    more = kind == "truncated"
                    ways.append((2 + more, "R", want))
                    if initials[i] == want or (initials[i] == "s" and state == ""):
                        ways.append((more, "K", initials[i]))
                return min([(c + rest[i + 1, t][0], e + rest[i + 1, t][1]) for c, e, t in ways], default=far)
            base = {s: step(s) for s in ("", "s", "u", "a")}
            for s in base:
                want = "a" if s == "u" else "u"
                then = "a" if want == "u" else "u"
                rest[i, s] = min(base[s], (base[want][0] + 2, "I" + base[want][1]), (base[then][0] + 4, "II" + base[then][1]))
        cost, audit = rest[0, ""]
        lines, state, at = [], "", 0
        for e in audit:
            role, text = ("", "") if e == "I" else rows[at][1:]
            at += e != "I"
            if e != "D":
                state = "s" if e == "K" and role[:1] == "s" else "a" if state == "u" else "u"
                lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        assert re.match(r"(s?(ua)+)?\Z", "".join(x[:1] for x in lines))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(rng, conv, n):
    start = [(conv, 0, "system", "Be brief.")] if rng.random() < 0.3 else []
    return start + [(conv, k + 1, ("user", "assistant")[k % 2] if rng.random() < 0.9 else rng.choice(["tool", "user", "", None]), rng.choice([f"Some text {rng.randrange(9)}.", "No end", " \n", "Why?\n "])) for k in range(n)]


@pytest.mark.parametrize("run", [256, 3])
def test_repair_query_equals_plain_python(spark, monkeypatch, run):
    monkeypatch.setattr(repair, "RUN", run)
    monkeypatch.setattr(repair, "FAN_IN", 4 if run == 3 else 64)
    rng = random.Random(8)
    rows = [r for c in range(120) for r in talk(rng, c, rng.randrange(0, 9))] + talk(rng, 500, 400)
    rows += [(None, None, None, None), (None, 2, "user", "Hi."), (900, None, "user", "x " * 20_000), (900, None, "assistant", "fin."), (901, 5, "assistant", None), *talk(rng, None, 5)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, chart string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(repair.damage(df), df).collect()}
    assert got == plain(rows)
    empty = df.limit(0)
    assert repair.repair_conversations(repair.damage(empty), empty).count() == 0


def test_conversation_without_rows_left_and_repaired_turns(spark):
    gone = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (1,)))
    df = spark.createDataFrame([(gone, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair_conversations(repair.damage(df), df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    turns = [(1, 0, "user", "One?"), (1, 1, "user", "Two"), (2, 3, "assistant", "Late.")]
    rows = repair.rows_of(spark.createDataFrame(turns, df.schema))
    found = repair.repairs(rows)
    out = sorted(map(tuple, repair.repaired_turns(rows, found).collect()))
    # re-roling the second turn costs 2 + 1; before the late answer a turn is inserted
    assert out == [(1, 0, "user", "One?"), (1, 1, "assistant", "Two"), (2, 0, "user", ""), (2, 1, "assistant", "Late.")]


# ---- whitening


def exact(vectors, components=16):
    """{vec_id: (n, deviation, whitened up to signs)} and explained shares, by a dense eigensolver over distinct vectors."""
    keep = {i: [int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, keep.values()))), object)
    n, sums = len(fit), fit.sum(0)
    y = np.array([[float(n * c - s) / n for c, s in zip(r, sums)] for r in fit.tolist()])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    rows = {i: (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.array([float(n * c - s) / n for c, s in zip(x, sums)]) @ q / np.sqrt(e)) for i, x in keep.items()}
    return rows, e / (y**2).sum() * n


@pytest.mark.parametrize("dims", [3, 40])
def test_whitening_equals_a_dense_solver(spark, dims):
    rng = np.random.default_rng(dims)
    x = (rng.normal(size=(700, dims)) * rng.gamma(1, 1, dims) + rng.normal(size=(7, dims))[rng.integers(0, 7, 700)]).astype(np.float32)
    data = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    data += [(k, data[5][1]) for k in range(1000, 1300)] + [(2000, None), (2001, [None, *data[0][1][1:]]), (2002, [float("nan"), *data[0][1][1:]]), (2003, [float("-inf"), *data[0][1][1:]])]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<float>, x int, n string").repartition(5)
    want, share = exact(data, min(16, dims))
    got = defaultdict(dict)
    for r in whiten(df).collect():
        got[r.vec_id][r.component] = r
    assert got.keys() == want.keys()
    sign = None
    for i, (n, deviation, white) in want.items():
        mine = np.array([got[i][k].whitened for k in sorted(got[i])])
        assert sorted(got[i]) == list(range(1, len(white) + 1)) and {(r.n, r.deviation) for r in got[i].values()} == {(n, deviation)}
        sign = np.sign(mine * white) if sign is None else sign
        assert np.allclose(mine, white * sign, atol=1e-9)
    one = got[0]
    assert np.allclose([one[k].explained for k in sorted(one)], share, rtol=1e-10) and max(r.identity_error for r in one.values()) < 1e-10


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    rows = lambda data: whiten(spark.createDataFrame(data, schema)).collect()
    assert rows([]) == [] and rows([(1, None), (2, [])]) == [] and rows([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = rows([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (2, [1.0, 5.0]), (None, [0.0, 5.0]), (4, [1.0])])
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 2), (1, 1, 2), (2, 1, 2), (2, 1, 2)]


def test_spectra_are_eigenpairs(spark):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(3000, 12)) * rng.gamma(1, 30, 12)).astype(np.int64) + 1000000
    x[:, 3], x[:, 5] = 1000007, x[:, 6]  # a constant and a repeated dimension: deflation
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(40)
    s = spectra(df, 12, block=50)
    scatter = np.cov(x.T.astype(float), bias=True) * len(x)
    assert s.n == 3000 and (s.sums == x.sum(0)).all() and np.allclose(s.mean, x.mean(0), rtol=1e-12)
    assert np.abs((s.vectors * s.values) @ s.vectors.T - scatter).max() < 1e-10 * scatter.max() and np.allclose(s.vectors.T @ s.vectors, np.eye(12), atol=1e-12)
    by_row = Spectrum.empty(12)
    for r in x[:200]:
        by_row.update(r[None])
    assert np.allclose((by_row.vectors * by_row.values) @ by_row.vectors.T, np.cov(x[:200].T.astype(float), bias=True) * 200, atol=1e-8 * scatter.max())


@pytest.mark.parametrize("seed", range(8))
def test_rank_one_update(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 30))
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = np.sort(np.round(rng.gamma(1, 10, d), int(rng.integers(0, 3))))
    v = rng.normal(size=d) * 10.0 ** rng.integers(-9, 4) * (rng.random(d) < 0.7)
    want = (q * values) @ q.T + np.outer(v, v)
    e, u = rank_one(values, q, v)
    assert (np.diff(e) >= 0).all() and np.allclose((u * e) @ u.T, want, atol=1e-12 * max(1, np.abs(want).max())) and np.allclose(u.T @ u, np.eye(d), atol=1e-12)
