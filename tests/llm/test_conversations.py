"""Structure repair and prefix trie against plain versions, odd rows included."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from telemetra.llm import prefix_trie, structure_repair

ROWS = "conv_id bigint, turn bigint, role string, text string"
TEXTS = ["yes.", "no", "  ", "", "why?", "so\n", "right! \t"]


@pytest.fixture
def conversations(spark):
    return lambda rows: spark.createDataFrame(rows, ROWS)


# ---------------------------------------------------------------- 11 structure repair

def plain_repair(rows):
    """Every edit sequence with up to two inserts; (cost, audit, lines)."""
    rows, seen, faults, must, cut = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])), set(), [0, 0, 0], [], []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        cut.append(body[-1:] not in (".", "!", "?"))
        kind = 0 if not body else 1 if (role, text) in seen else 2 if cut[-1] else None
        if kind is not None:
            faults[kind] += 1
        must.append(kind in (0, 1))
        seen.add((role, text))
    best = None

    def go(i, cost, audit, lines, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
        else:
            _, role, text = rows[i]
            extra = 5 * cut[i]
            if not must[i]:
                if role[:1] in tuple("sua"):
                    go(i + 1, cost + extra, audit + "K", [*lines, (role, text)], inserts)
                for name in ("user", "assistant"):
                    go(i + 1, cost + 1 + extra, audit + "R", [*lines, (name, text)], inserts)
            go(i + 1, cost + 2, audit + "D", lines, inserts)
        if inserts < 2:
            for name in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*lines, (name, "")], inserts + 1)

    go(0, 0, "", [], 0)
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    joined = "\n".join(f"{a}:{b}" for a, b in best[2])
    return (gaps, *faults, illegal, best[0], best[1], hashlib.sha256(joined.encode()).hexdigest())


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def test_repair_against_every_edit_sequence(conversations):
    rng = random.Random(4)
    rows = [(c, rng.choice([t, t, t + 3, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice([*TEXTS, None, f"t{t}."]))
            for c in [None, *range(60)] for t in range(rng.randrange(1, 6))]
    got = {r[0]: tuple(r)[1:] for r in structure_repair.repair(structure_repair.damage(conversations(rows))).collect()}
    want = {c: plain_repair(own) for c, own in damaged(rows).items()}
    assert got == want


def test_repair_without_damage_and_other_costs(conversations):
    rows = [(1, 0, "system", "be kind."), (1, 1, "assistant", "hi."), (1, 2, "user", "why?")]
    plain = structure_repair.repair(structure_repair.as_rows(conversations(rows))).first()
    assert (plain["cost"], plain["audit"]) == (2, "KRR")
    assert (plain["illegal"], plain["gaps"], plain["truncated"]) == (1, 0, 0)
    cheap = structure_repair.repair(structure_repair.as_rows(conversations(rows)), structure_repair.Costs(rerole=50, delete=40, insert=5)).first()
    assert (cheap["cost"], cheap["audit"]) == (10, "KIKKI")


def test_repair_of_a_long_conversation_settles_letters(conversations):
    """Far more letters than the integers are wide, and no legal row at all in the middle."""
    n = 3000
    rows = [(7, t, ("user", "assistant")[t % 2] if t < 1000 or t > 2000 else "tool", f"t{t}.") for t in range(n)]
    got = structure_repair.repair(structure_repair.as_rows(conversations(rows))).first()
    lines, roles = [], []
    for (_, _, role, text), letter in zip(rows, got["audit"], strict=True):
        if letter == "D":
            continue
        name = role if letter == "K" else "assistant" if roles and roles[-1] == "u" else "user"
        roles.append(name[0])
        lines.append(f"{name}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(roles))
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == got["repaired_sha256"]
    assert got["cost"] == got["audit"].count("R") + 2 * got["audit"].count("D")


def test_integers_decide_like_tuples():
    """The graph against the same search over (cost, audit) tuples, without settled letters."""
    rng = random.Random(8)
    for _ in range(20):
        rows = [(rng.choice([b"user", b"assistant", b"system", b"tool"]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(150)]
        graph = structure_repair.Repair()
        best = {structure_repair.START: (0, "")}
        for role, must, cut in rows:
            graph.add(role, b"x", must, cut)
            made = defaultdict(list)
            for state, (cost, audit) in best.items():
                made[state].append((cost + 2, audit + "D"))
                if not must:
                    initial = chr(role[0])
                    if initial in structure_repair.FOLLOWS[state]:
                        made[structure_repair.FOLLOWS[state][initial]].append((cost + 5 * cut, audit + "K"))
                    made[structure_repair.NEXT[state]].append((cost + 1 + 5 * cut, audit + "R"))
            best = {s: min(x) for s, x in made.items()}
        assert graph.result()[:2] == min(best[s] for s in (structure_repair.START, structure_repair.ASSISTANT) if s in best)


# ---------------------------------------------------------------- 12 prefix trie

def plain_trie(rows, block=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(own.get(c - c % block, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        yield p
        for k in kids[p]:
            yield from under(k)

    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == p)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under(p)),
                 sum((len(members[q]) - 1) * len(q[-1][1]) for q in under(p) if q), hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


@pytest.mark.parametrize(("seed", "tree_bytes"), [(1, 2 << 20), (2, 1000), (3, 300)])
def test_trie_against_a_plain_version(spark, conversations, monkeypatch, seed, tree_bytes):
    """Many ranges, so that most nodes are met by several tasks."""
    monkeypatch.setattr(prefix_trie, "TREE_BYTES", tree_bytes)
    rng = random.Random(seed)
    texts = ["a", "bb", "ccc", "\U0001f600", "", None]
    rows = [(c, t if rng.random() < 0.9 or t else None, rng.choice(["user", "assistant", None]) if c % 3 else "user", rng.choice(texts) if c % 3 else "same")
            for c in [*range(0, 40), *range(100, 160), *range(205, 230), 1000] for t in range(rng.randrange(1, 8))]
    rows.append((None, 0, "user", "lost"))
    found = prefix_trie.trie(prefix_trie.rebuilt_keys(prefix_trie.turn_ids(conversations(rows)))).collect()
    want, n = plain_trie(rows)
    assert len(found) == n and {tuple(r) for r in found} == want


def test_trie_nodes_grow_through_all_layouts():
    tree, rng = prefix_trie.RadixTree(), random.Random(5)
    keys = sorted({bytes([a]) * 20 + bytes([b, rng.randrange(256)]) * 10 for a in range(256) for b in range(0, 256, a + 1)})
    for k in keys:
        tree.insert(k, (k, 1, keys.index(k) if len(keys) < 50 else 0, "x"))
    kinds, todo = set(), [(tree.root, b"")]
    found = []
    while todo:
        node, above = todo.pop()
        kinds.add(type(node.kids).__name__ + (str(node.kids.size) if isinstance(node.kids, prefix_trie.Few) else ""))
        whole = above + node.path
        if node.own:
            found.append(whole)
        todo += [(kid, whole + bytes([b])) for b, kid in node.kids.items()]
    assert sorted(found) == keys and kinds == {"Few4", "Few16", "Indexed", "Direct"}


def test_trie_of_nested_conversations_has_no_depth_limit(spark):
    ids = [i.to_bytes(16, "big") + (1).to_bytes(4, "big") for i in range(3000)]
    rows = [(n, b"".join(ids[:n])) for n in range(0, 3000, 500)]
    got = {(r["depth"], r["conv_id"]): r for r in prefix_trie.trie(spark.createDataFrame(rows, "conv bigint, key binary")).collect()}
    assert len(got) == 2501 and got[0, 0]["n_convs"] == 6 and got[0, 0]["saved_tokens"] == 500 * (4 + 3 + 2 + 1)
    assert got[2500, 2500]["n_leaves"] == 1 and got[501, 1000]["parent_conv_id"] == 500


def test_empty_tables_and_clashing_columns(conversations):
    none = conversations([]).limit(0)
    assert structure_repair.repair(structure_repair.damage(none)).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt_keys(prefix_trie.turn_ids(none))).count() == 0
    odd = conversations([(0, 0, "user", "hi.")])
    for name in ("conv", "kind", "seen", "gone", "repeat", "part", "key", "id", "base", "head", "own", "before"):
        odd = odd.withColumn(name, odd["text"])
    assert structure_repair.repair(structure_repair.damage(odd)).count() == 1
    assert prefix_trie.trie(prefix_trie.rebuilt_keys(prefix_trie.turn_ids(odd))).count() == 2
