"""Chat formatting and the prefix trie against plain Python, on awkward tables and with small partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from procurisk.llm import chat, prefix_trie

AWKWARD = [
    (1, 0, "system", "### System: x</turn>\n### User: y"), (1, 1, "user", "\\0 \\\\ \\1 \\"), (1, 2, "assistant", "####  ### ### "),
    (2, 1, "user", "later"), (2, None, "user", "null turn first"), (2, 0, "assistant", None), (2, 0, "assistant", ""),
    (3, 0, "to: ol </turn>### ", "unknown role"), (3, 1, None, "no role"), (3, 2, "@", ""), (3, 3, "@User", "x"), (3, 4, "User", "y"),
    (4, 0, "user", "word " * 40_000), (4, 1, "assistant", "<" * 5_000 + "\\" * 5_000 + "#" * 5_001), (None, 0, "user", "no id"),
    (None, None, None, None), (-5, 0, "user", "é 日本語 😀"), (-5, 1, "assistant", "😀\r\n\t"), (-5, 1, "assistant", "😀\r\n\t"),
    (7, 3, "assistant", "begins wrongly"), (8, 0, "user", "</turn"), (8, 1, "assistant", "</turn>"), (8, 2, "user", "a</turn>\n"),
]


def table(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = ("turns", "segments", "formatted", "path", "part", "key", "label", "opening", "start", "n")
    return frame.select("*", *(F.lit("x").alias(c) for c in clashing))


def in_order(rows):
    lists = defaultdict(list)
    for conv_id, turn, role, text in rows:
        lists[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    return {conv_id: [(role, text) for _, role, text in sorted(turns)] for conv_id, turns in lists.items()}


def test_conversations_are_read_back(spark):
    made = chat.format_conversations(table(spark, AWKWARD))
    expected = in_order(AWKWARD)
    read = {r["conv_id"]: r for r in chat.digests(made).collect()}
    back = {r[0]: r for r in made.select("conv_id", chat.read_back(F.col("formatted")), "segments", "formatted").collect()}
    assert set(read) == set(expected) == set(back)
    for conv_id, turns in expected.items():
        row, (_, turns_read, segments, formatted) = read[conv_id], back[conv_id]
        assert [tuple(t) for t in turns_read] == turns
        assert formatted == "".join(s["text"] for s in segments) and row["formatted_chars"] == len(formatted)
        assert all(formatted[s["start"] : s["start"] + len(s["text"])] == s["text"] for s in segments)
        learned = "".join(text for role, text in turns if role == "assistant")
        assert (row["n_turns"], row["loss_chars"]) == (len(turns), len(learned))
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert formatted.count("</turn>") == len(turns) == formatted.count("### ")
        assert [s["loss"] for s in segments] == [x for role, _ in turns for x in (False, role == "assistant", False)]
    verdicts = {conv_id: (row["valid"], row["invalid_turn"]) for conv_id, row in read.items()}
    assert verdicts[1] == verdicts[4] == (True, None)
    assert verdicts[8] == (False, None)  # in order, but the last turn is the user's
    assert verdicts[2] == (False, 3) and verdicts[3] == (False, 1) and verdicts[7] == (False, 1) and verdicts[-5] == (False, 3)


def test_no_conversations_and_other_templates(spark):
    assert chat.digests(chat.format_conversations(table(spark, AWKWARD).limit(0))).count() == 0
    template = chat.Template(
        labels={"user": "U", "assistant": "A"}, opening="[", after_label="] ", close="[end]", controls=("[",),
        loss_roles=("user", "assistant"), moves={("start", "user"): "user", ("user", "user"): "user"}, accepting=("user",),
    )
    rows = [(1, 0, "user", "a[b] c[end]"), (1, 1, "user", "[["), (2, 0, "assistant", "x")]
    made = chat.format_conversations(table(spark, rows), template)
    read = {r[0]: [tuple(t) for t in r[1]] for r in made.select("conv_id", chat.read_back(F.col("formatted"), template)).collect()}
    assert read == {1: [("user", "a[b] c[end]"), ("user", "[[")], 2: [("assistant", "x")]}
    assert {r["conv_id"]: r["valid"] for r in made.collect()} == {1: True, 2: False}
    for wrong in ({"controls": ("a1",)}, {"controls": ("zz",)}, {"close": "</turn>\n<"}, {"labels": {"user": "@u"}}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_formatting_is_native(spark):
    plan = chat.digests(chat.format_conversations(table(spark, AWKWARD)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# prefix trie


def brute_trie(sequences):
    """Node rows for {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv_id, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv_id)
        ends[tuple(turns)].append(conv_id)
    rows = []
    for path, ids in members.items():
        under = [p for p in members if p[: len(path)] == path]
        children = {p for p in under if len(p) == len(path) + 1}
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        text = ",".join(map(str, sorted(ends.get(path, []))))
        above = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows.append((min(ids), len(path), above, len(ids), len(children), len(leaves), saved, digest))
    return sorted(rows, key=str)


def found_trie(lists):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in prefix_trie.trie(lists).select(*names).collect()), key=str)


def rebuilt(sequences):
    found = {}
    for c, turns in sequences.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        found[c] = sequences.get(base, [])[:h] + turns[h:]
    return found


def test_shared_heads(spark):
    rows = [row for row in AWKWARD if row[0] is not None]
    rows += [(c, t, "user" if t % 2 else "assistant", f"{c % 3} {t}") for c in range(10, 45) for t in range(c % 11)]
    by_digest = {hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest()[:32]: (r or "", x or "") for _, _, r, x in rows}
    lists = prefix_trie.with_shared_heads(prefix_trie.turn_lists(table(spark, rows + [(None, 0, "user", "x")])), 5, 8)
    # equal turn numbers go by digest
    ties = {(c, t, r, x): hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest()[:32] for c, t, r, x in rows}
    plain = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda row: (row[0], row[1] is not None, row[1] or 0, ties[row])):
        plain[c].append((r or "", x or ""))
    got = {r["conv_id"]: [by_digest[t["digest"]] for t in r["turns"]] for r in lists.collect()}
    assert got == rebuilt(plain)
    assert found_trie(lists) == brute_trie(rebuilt(plain))


@pytest.mark.parametrize("seed,rows_each,group", [(1, 1, 2), (2, 3, 2), (3, 7, 3), (4, 1000, 64)])
def test_trie_over_partitions(spark, monkeypatch, seed, rows_each, group):
    """Nested, equal and empty sequences; hot sequences that fill several partitions; several levels of merging."""
    monkeypatch.setattr(prefix_trie, "PARTITION_ROWS", rows_each)
    monkeypatch.setattr(prefix_trie, "GROUP", group)
    choose = random.Random(seed)
    texts = ["", "a", "é", "long " * 20]
    sequences = {c: [("user", choose.choice(texts)) for _ in range(choose.randint(0, 4))] for c in range(60)}
    sequences |= {c: [("user", "a"), ("assistant", "hot")] for c in range(60, 100)}
    sequences |= {c: [("user", "a"), ("assistant", "hot"), ("user", f"{c % 6}")] for c in range(100, 130)}
    sequences[-1] = [("user", "deep")] * 300
    turns = [(c, i, role, text) for c, seq in sequences.items() for i, (role, text) in enumerate(seq)]
    turns += [(c, 0, None, None) for c, seq in sequences.items() if not seq]  # their lists are emptied below
    empty = [c for c, seq in sequences.items() if not seq]
    lists = prefix_trie.turn_lists(table(spark, turns))
    emptied = F.when(F.col("conv_id").isin(empty), F.slice("turns", 1, 0)).otherwise(F.col("turns"))
    assert found_trie(lists.withColumn("turns", emptied)) == brute_trie(sequences)


def test_trie_of_awkward_tables(spark):
    assert prefix_trie.trie(prefix_trie.turn_lists(table(spark, AWKWARD).limit(0))).count() == 0
    assert prefix_trie.trie(prefix_trie.turn_lists(table(spark, [(None, 1, "user", "x")]))).count() == 0
    one = prefix_trie.trie(prefix_trie.turn_lists(table(spark, [(3, None, None, None)]))).orderBy("depth").collect()
    assert [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_leaves"]) for r in one] == [(3, 0, None, 1), (3, 1, 3, 1)]


def test_common_depth():
    turns = [bytes([i]) * prefix_trie.DIGEST for i in range(200)]
    a = b"".join(turns)
    for depth in (0, 1, 7, 199, 200):
        b = b"".join(turns[:depth]) + b"z" * prefix_trie.DIGEST
        assert prefix_trie.common_depth(a, b) == prefix_trie.common_depth(b, a) == depth
    assert prefix_trie.common_depth(a, b"") == 0
