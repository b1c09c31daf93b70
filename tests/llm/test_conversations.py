"""Prefix trie and structure repair against brute force, with hot, long, odd and empty conversations."""

import hashlib
import random
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from canopyframe.llm import prefix_trie, queries, structure_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def symbol(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, symbol(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(donor, [])[:h] + v[h:])
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    out = {}
    for key in members:
        out[key] = [0, 0, 0]
    for key in members:
        if key:
            out[key[:-1]][0] += 1
    for key, m in members.items():
        leaf = out[key][0] == 0
        saved = (len(m) - 1) * len(key[-1][1]) if key else 0
        for d in range(len(key) + 1):
            out[key[:d]][1] += leaf
            out[key[:d]][2] += saved
    return sorted(
        (min(m), len(key), min(members[key[:-1]]) if key else None, len(m), *out[key], sha(",".join(map(str, sorted(c for c in m if len(full[c]) == len(key))))))
        for key, m in members.items())


def trie_rows(df):
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(df).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def sample():
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(95, 130), -5, -150, 205]:
        n = draw.choice([1, 2, 3, 5, 8, 9])
        rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "bb", "c\nc", ""])) for t in range(n)]
    rows += [(40, None, "user", "x"), (40, None, "user", None), (40, None, None, "x"), (40, 3, "user", "x"), (40, 3, "user", "x"), (None, 1, "user", "lost"), (41, 1, "user", None)]
    rows += [(c, t, "user", f"t{t}") for c in (43, 44) for t in range(150)] + [(45, t, "user", f"t{t}" if t < 97 else "other") for t in range(120)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("name", "i", "len", "sym", "n", "depth", "parent"):
        df = df.withColumn(name, F.lit("clash"))
    assert trie_rows(df) == brute_trie(rows)


def test_trie_of_one_common_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1, 400) for t in range(7)] + [(400 + c, 0, "user", f"own {c}") for c in range(60)]
    assert trie_rows(spark.createDataFrame(rows, SCHEMA)) == brute_trie(rows)


def test_trie_of_many_children(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MANY", 3)
    rows = sample()
    assert trie_rows(spark.createDataFrame(rows, SCHEMA)) == brute_trie(rows)


def test_trie_edges(spark):
    assert trie_rows(spark.createDataFrame([], SCHEMA)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    # Conversation 3 takes three turns of an absent conversation and has no more of its own: the root alone.
    lone = [(3, 1, "user", "x")]
    assert trie_rows(spark.createDataFrame(lone, SCHEMA)) == brute_trie(lone) == [(3, 0, None, 1, 0, 1, 0, sha("3"))]


# Repair ----------------------------------------------------------------------------------------

def sound(initials):
    if initials == "":
        return True
    rest = initials[1:] if initials[0] == "s" else initials
    return len(rest) >= 2 and len(rest) % 2 == 0 and all(c == "ua"[i % 2] for i, c in enumerate(rest))


def brute_repair(rows):
    """(cost, audit, lines) by trying every edit of every row with up to two insertions at each place."""
    options = []
    seen = set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        must = not bare or (role, text) in seen
        seen.add((role, text))
        extra = int(bool(bare) and bare[-1] not in ".!?")
        o = [(3, "D", ())]
        if not must:
            o += [(extra, "K", ((role[:1] or "-", role, text),))] + [(2 + extra, "R", ((r[0], r, text),)) for r in ("user", "assistant")]
        options.append(o)
    gap = [(0, "", ())]
    for n in (1, 2):
        gap += [(2 * n, "I" * n, tuple((r[0], r, "") for r in rs)) for rs in product(("user", "assistant"), repeat=n)]
    best = None
    for choice in product(*[x for o in options for x in (gap, o)], gap):
        cost, audit = sum(c[0] for c in choice), "".join(c[1] for c in choice)
        if best is not None and (cost, audit) >= best[:2]:
            continue
        turns = [t for c in choice for t in c[2]]
        if sound("".join(t[0] for t in turns)):
            best = (cost, audit, [f"{t[1]}:{t[2]}" for t in turns])
    return best


def full_report(rows):
    """All columns of one conversation by a plain dynamic program over rows (for longer ones)."""
    seen, states = set(), {0: (0, "", ())}
    for p, q, n in ((0, 2, 1), (0, 3, 2)):
        states[q] = (2 * n, "I" * n, ("user:", "assistant:")[:n])
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        must = not bare or (role, text) in seen
        seen.add((role, text))
        extra = int(bool(bare) and bare[-1] not in ".!?")
        new = {}

        def put(q, cell, new=new):
            if q not in new or cell[:2] < new[q][:2]:
                new[q] = cell

        for p, (c, a, t) in states.items():
            put(p, (c + 3, a + "D", t))
            if not must:
                for (p2, r), q in step.items():
                    if p2 == p and role[:1] == r:
                        put(q, (c + extra, a + "K", (*t, f"{role}:{text}")))
                    if p2 == p and r != "s":
                        put(q, (c + 2 + extra, a + "R", (*t, f"{names[r]}:{text}")))
        for _ in range(2):
            for p, (c, a, t) in list(new.items()):
                for (p2, r), q in step.items():
                    if p2 == p and r != "s":
                        put(q, (c + 2, a + "I", (*t, f"{names[r]}:")))
        states = new
    return min(states[q] for q in (0, 3) if q in states)


def test_parse_equals_trying_everything():
    draw = random.Random(3)
    for _ in range(120):
        rows = [(draw.choice(["user", "assistant", "system", " "]), draw.choice(["Fine.", "cut off", " ", "Yes!"])) for _ in range(draw.randint(1, 3))]
        cost, audit, lines = brute_repair(rows)
        plain = full_report(rows)
        assert plain[:2] == (cost, audit) and list(plain[2]) == lines, rows


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_reports(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of undamaged rows."""
    out = {}
    groups = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        groups.setdefault(c, []).append((t is not None, t or 0, role, hashlib.sha256(text.encode()).digest(), text))
    for c, v in groups.items():
        v.sort(key=lambda x: x[:4])
        pairs = [(x[2], x[4]) for x in v]
        turns = {x[1] for x in v if x[0]}
        seen, faults = set(), [0, 0, 0]
        for role, text in pairs:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if kind is not None:
                faults[kind] += 1
            seen.add((role, text))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, lines = full_report(pairs)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, list(lines))
    return out


def check_repair(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("SPAN", F.lit(1))
    reports, repaired = structure_repair.repair(df)
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: r["at"]):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    got = {r.conv_id: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), lines.get(r.conv_id, [])) for r in reports.collect()}
    want = brute_reports(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def odd_rows():
    draw = random.Random(11)
    rows = []
    for c in [*range(30), None]:
        for t in range(draw.randint(1, 9)):
            rows.append((c, draw.choice([t, t, t + 3, None]), draw.choice(["user", "assistant", "assistant", "system", "tool", "", None]), draw.choice(["Fine.", "cut off", "Yes! \n", "", None, "  ", "Well?", "x" * 3000 + "."])))
    return rows


def test_repair_equals_brute_force(spark):
    check_repair(spark, odd_rows())


def test_long_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(structure_repair, "SPAN", 8)
    monkeypatch.setattr(structure_repair, "FAN", 3)
    draw = random.Random(2)
    rows = [(1, t, draw.choice(["user", "assistant", "system"]), draw.choice([f"Line {t}.", f"open {t}", "again.", ""])) for t in range(400)]
    rows += [(2, 5, "user", "the same row.")] * 90 + [(3, t, ["user", "assistant"][t % 2], f"Fine {t}.") for t in range(64)] + odd_rows()[:40]
    check_repair(spark, [r if r[0] != 0 else (9, *r[1:]) for r in rows])


def test_damage_is_as_stated(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(5)] + [(None, None, None, None)]
    got = as_rows(structure_repair.damage(spark.createDataFrame(rows, SCHEMA)))
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        new = (c, t, "user" if fate == 4 else role, "" if fate == 1 else text.replace(".", "").replace("!", "") if fate == 2 else text)
        want += [] if fate == 0 else [new] * (2 if fate == 3 else 1)
    assert got == sorted(want, key=repr)


def test_no_rows(spark):
    reports, repaired = structure_repair.repair(spark.createDataFrame([], SCHEMA))
    assert reports.count() == 0 and repaired.count() == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_structure_repair"])
def test_queries_equal_their_sql(spark, folder, name):
    import check

    assert check.compare(queries.QUERIES[name](spark, folder), check.connect(folder), queries.SQL[name]).startswith("ok")
