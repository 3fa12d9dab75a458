"""Repair of conversations and packing into sequences: brute force, the library's ids, and the defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("latticework.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from latticework.llm import conversations, embedding_dedup, packing  # noqa: E402

BYTE = public_tokenizers.path("byte_bpe_50k.json")
CONV = "conv_id long, turn long, role string, text string, audit string, copies string, again string, digest string, c string, r string, first string, n string"
DOCS = "doc_id long, text string, length string, part string, base string, k string"
SPACE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    """With extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, *["9"] * 8) for r in rows], CONV)


# ---- 11: conversations ----


def damage(rows):
    """Turns of each conversation in order, from (conv_id, turn, role, text) rows, by the contract's words."""
    out = {}
    for c, t, role, text in rows:
        turns = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        turns += [(t, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    for turns in out.values():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    return out


def faults_of(turns):
    out, seen = [], set()
    for _, role, text in turns:
        stripped = text.strip(SPACE)
        out.append("b" if not stripped else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, insert=5):
    """(cost, audit, repaired lines) by trying every sequence of edits; at most two inserts stand in one gap."""
    faults, best = faults_of(turns), (2 * len(turns), "D" * len(turns), [])  # all may be deleted
    pattern = re.compile("(s?(ua)+)?")

    def go(i, cost, audit, roles, lines, inserts):
        nonlocal best
        if not re.fullmatch("s?(ua)*u?", roles) or cost > best[0]:
            return
        if inserts < 2:
            for role in ("user", "assistant"):
                go(i, cost + insert, audit + "I", roles + role[0], [*lines, f"{role}:"], inserts + 1)
        if i == len(turns):
            if pattern.fullmatch(roles):
                best = min(best, (cost, audit, lines))
            return
        _, role, text = turns[i]
        go(i + 1, cost + 2, audit + "D", roles, lines, 0)
        if faults[i] in ("", "t"):
            more = 5 * (faults[i] == "t")
            if role[:1] in ("s", "u", "a") and role:
                go(i + 1, cost + more, audit + "K", roles + role[:1], [*lines, f"{role}:{text}"], 0)
            for new in ("user", "assistant"):
                go(i + 1, cost + 1 + more, audit + "R", roles + new[0], [*lines, f"{new}:{text}"], 0)

    go(0, 0, "", "", [], 0)
    return best


def expected(rows):
    out = []
    for c, turns in damage(rows).items():
        faults = faults_of(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        cost, audit, lines = cheapest(turns)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out.append((c, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, convs=60, longest=5):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "Yes. ", "…", "ü.", "x\x85", None]
    roles = ["user", "assistant", "system", "tool", "unknown", "", None, "User"]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t * 3, 0, None])
            rows.append((c if c else None, turn, rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repairs_are_brute_force(spark, seed):
    rows = random_rows(seed)
    got = conversations.repair(conversations.damaged(table(spark, rows).repartition(3)))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_repairs_are_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for seed in range(10, 16) for r in [(100 * seed + (-1 if c is None else c), t, role, x) for c, t, role, x in random_rows(seed, 40, 9)]]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = conversations.repair(conversations.damaged(table(spark, rows)))
    found = con.execute(conversations.ORACLE)
    names = [d[0] for d in found.description]
    want = sorted(tuple(r[names.index(c)] for c in got.columns) for r in found.fetchall())
    assert sorted(map(tuple, got.collect())) == want


def test_turns_come_back_repaired(spark):
    rows = random_rows(7, 80, 8)
    turns = conversations.damaged(table(spark, rows))
    repairs = conversations.repair(turns)
    back = {}
    for r in conversations.repaired_turns(turns, repairs).collect():
        back.setdefault(r["conv_id"], []).append(r)
    assert any(r["edit"] == "R" for v in back.values() for r in v)
    for r in repairs.collect():
        mine = sorted(back.get(r["conv_id"], []), key=lambda x: x["place"])
        assert [x["place"] for x in mine] == list(range(len(mine)))
        assert "".join(x["edit"] for x in mine) == r["audit"].replace("D", "")
        text = "\n".join(f"{x['role']}:{x['text']}" for x in mine)
        assert hashlib.sha256(text.encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in mine))


def test_inserts_where_they_are_cheap(monkeypatch):
    """At their price of 5 a deletion is always cheaper; at 1 and 2 they are used, and the audits' ties are many."""
    some = 0
    for insert in (1, 2):
        monkeypatch.setattr(conversations, "INSERT", insert)
        for c, turns in damage(random_rows(30 + insert, 150, 5)).items():
            conv = conversations.Conversation(c)
            for f, (turn, role, text) in zip(faults_of(turns), turns):
                conv.add(turn, role, text, 1, f == "d")
            cost, audit, lines = cheapest(turns, insert)
            assert conv.result()[6:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
            some += "I" in audit
    assert some > 50


def test_inserted_turns_come_back(spark):
    turns = conversations.plain(table(spark, [(1, 0, "assistant", "x."), (1, 1, "user", "y."), (2, 0, "system", "z")]))
    repairs = spark.createDataFrame([(1, "IKKI"), (2, "KII")], "conv_id long, audit string")
    got = sorted((r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in conversations.repaired_turns(turns, repairs).collect())
    assert got == [
        (1, 0, "I", "user", ""), (1, 1, "K", "assistant", "x."), (1, 2, "K", "user", "y."), (1, 3, "I", "assistant", ""),
        (2, 0, "K", "system", "z"), (2, 1, "I", "user", ""), (2, 2, "I", "assistant", ""),
    ]


def test_one_long_conversation_in_bounded_steps():
    """A conversation of many turns: cost by a plain table of states, four bytes a turn."""
    rng = random.Random(5)
    turns = [(k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", ""]) + str(k) + rng.choice([".", ""])) for k in range(20_000)]
    conv = conversations.Conversation(1)
    for t in turns:
        conv.add(*t, 1, False)
    assert len(conv.steps) == 4 * len(turns)
    state = {0: 0}  # 0 none, 1 s, 2 u, 3 a
    for _, role, text in turns:
        new = {s: c + 2 for s, c in state.items()}
        if text.strip(SPACE):
            more = 5 * (text.strip(SPACE)[-1] not in ".!?")
            for s, c in state.items():
                for to in (1, 2, 3):
                    own = role[:1] == " sua"[to]
                    if to == 1 and (s or not own):
                        continue
                    between = 0 if to == 1 or (to == 2) == (s != 2) else 5
                    new[to] = min(new.get(to, 1 << 60), c + between + more + (not own))
        state = new
    assert conv.result()[6] == min(c + {0: 0, 1: 10, 2: 5, 3: 0}[s] for s, c in state.items())


def test_conversations_dropped_and_empty(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = conversations.repair(conversations.damaged(table(spark, [(gone, 0, "user", "Hi.")]))).collect()
    assert list(map(tuple, got)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair(conversations.damaged(table(spark, []))).collect() == []
    same = conversations.repair(conversations.plain(table(spark, [(1, 1, "user", "a."), (1, 1, "user", "a."), (1, 2, "assistant", "b.")]))).collect()
    assert (same[0]["duplicate"], same[0]["audit"], same[0]["cost"]) == (1, "KDK", 2)


# ---- 12: packing ----


def fewest(sizes, capacity):
    """The least number of sequences, by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= sizes[k]}):
            rest = list(rooms)
            rest.remove(r)
            go(k + 1, [*rest, r - sizes[k]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best


def counts_of(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1)


def test_dominance_keeps_the_fewest():
    rng, some = random.Random(11), 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 31])
        low = rng.choice([1, 3, 6])
        sizes = [rng.randint(low, capacity) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.dominance(counts_of(sizes, capacity))
        left = [k for k, n in enumerate(rest) for _ in range(n)]
        used = [x for contents, many in fixed for x, k in contents for _ in range(k * many)]
        assert sorted(used + left) == sorted(sizes)
        assert all(sum(x * k for x, k in contents) <= capacity for contents, _ in fixed)
        assert sum(many for _, many in fixed) + (fewest(left, capacity) if left else 0) == fewest(sizes, capacity)
        some += bool(fixed)
    assert some > 300


def test_best_fit_by_counts_is_best_fit_one_by_one():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 50, 97])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 60))), reverse=True)
        rooms = []
        for s in sizes:
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - s)
        made = packing.best_fit(counts_of(sizes, capacity))
        assert sum(many for _, many in made) == len(rooms)
        assert sorted(capacity - sum(x * k for x, k in contents) for contents, many in made for _ in range(many)) == sorted(rooms)


def test_plans_hold_every_piece_once_and_stay_small():
    rng = np.random.default_rng(1)
    sizes = np.minimum(1 + rng.lognormal(5, 1.5, 200_000).astype(int), 2048)
    counts = counts_of(sizes, 2048)
    plan = packing.plan(counts)
    size = np.repeat(np.arange(2049), counts)
    k = np.concatenate([np.arange(n) for n in counts])
    seq, offset = plan.find(size, k)
    order = np.lexsort([offset, seq])
    seq, offset, size = seq[order], offset[order], size[order]
    first = np.r_[True, seq[1:] != seq[:-1]]
    assert (offset[first] == 0).all() and (offset[1:] == offset[:-1] + size[:-1])[~first[1:]].all()
    assert (offset + size).max() <= 2048 and len(np.unique(seq)) == plan.sequences
    assert plan.sequences <= -(-sizes.sum() // 2048) + 2
    assert len(plan.runs) < 64 * 2048


def test_pieces_are_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "TEXTS_AT_ONCE", 4)
    lib = Tokenizer.from_file(BYTE)
    texts = [None, "", "a", "word " * 700, "x" * 900, "<|endoftext|> 中文 é́", " \n ", "a b " * 16, *("tiny" for _ in range(40)), *("w " * k for k in range(60))]
    rows = [(k if k != 3 else None, t, *["9"] * 4) for k, t in enumerate(texts)]
    got, plan = packing.pack(spark.createDataFrame(rows, DOCS).repartition(5), BYTE, public_tokenizers.PATTERN, capacity=64)
    got = got.collect()
    want = []
    for k, t, *_ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(itertools.pairwise(cut)):
            want.append((k, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for a, b in itertools.pairwise(places):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
    assert all(o + n <= 64 for _, o, n in places) and len({p[0] for p in places}) == plan.sequences
    assert plan.sequences <= -(-sum(n for *_, n in places) // 64) + 1


def test_packing_nothing(spark):
    got, plan = packing.pack(spark.createDataFrame([], DOCS), BYTE, public_tokenizers.PATTERN)
    assert got.collect() == [] and plan.sequences == 0


def test_split_of_the_basic_plane_is_the_same():
    """Each character of the basic plane beside letters, numbers, spaces, marks and itself, split by both libraries."""
    import regex

    from latticework.llm.bpe import basic_plane

    quick, whole = basic_plane(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    assert quick is not None
    for at in range(0, 0x10000, 64):
        some = [chr(c) for c in range(at, at + 64) if not 0xD800 <= c <= 0xDFFF]
        text = "".join(f"a{c}b {c}1{c}  {c}.{c}\n{c}{c} 's{c}'t {c}" for c in some)
        assert quick.findall(text) == whole.findall(text)
    assert basic_plane(r"\w+") is None and basic_plane(r"[\S]") is None


def test_audits_count_links_only(spark):
    """With every query audited, the audited links are those of a brute count, both ways, without any vector's own match."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 16))
    x[200:] = x[:100] + rng.normal(size=(100, 16)) * 0.02  # near copies
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = int((unit @ unit.T >= 0.98).sum()) - 300
    report = {}
    table = lambda v: spark.createDataFrame([(k, r.tolist(), 1) for k, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(table(x), shard_rows=90, audit=1000, report=report).collect()
    assert sum(r["n_links"] for r in got) == links == report["audited"] > 150
    assert 0.9 <= report["recall"] <= 1.0
    embedding_dedup.near_duplicates(table(rng.normal(size=(50, 16))), report=report).collect()
    assert report["audited"] == 0 and report["recall"] is None
