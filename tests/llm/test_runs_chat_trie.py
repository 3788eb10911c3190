"""Periodic runs, chat formatting and the prefix trie against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from qtrlens.llm import chat, runs, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- periodic runs ------------------------------------------------------------------------

def _runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x + q < len(w):
            y = x
            while y + q < len(w) and w[y] == w[y + q]:
                y += 1
            if y - x + q >= max(12, 2 * q):
                found.setdefault((x, y - x + q), q)
            x = y + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def _answer(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = _runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_word_ids_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 6)):
            n, kind = int(rng.integers(0, 90)), rng.random()
            w = rng.integers(0, rng.choice([1, 2, 3, 5, 30]), n)
            if kind < 0.4 and n > 4:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, n // 2))
                w = np.array([w[i] if i < a else w[a + (i - a) % p] for i in range(n)])
            elif kind < 0.6 and n > 10:
                w = np.tile(w[: rng.integers(1, 10)], 9)
            elif kind < 0.8:  # Fibonacci words have many runs of many periods
                f, g = "0", "01"
                while len(g) < 100:
                    f, g = g, g + f
                w = np.array([int(c) for c in g[: rng.integers(10, 100)]])
            texts.append(w.astype(np.int64))
        off = np.r_[0, np.cumsum([len(t) for t in texts])]
        got = [[] for _ in texts]
        for t, *r in zip(*runs.find_runs(np.concatenate(texts), off)):
            got[t].append(tuple(r))
        assert got == [_runs(list(w)) for w in texts]


def test_a_grammar_derives_the_texts():
    rng = np.random.default_rng(5)
    ids, off = np.r_[np.tile(rng.integers(0, 4, 7), 6), rng.integers(0, 3, 50)].astype(np.int64), np.array([0, 42, 92])
    held = {i: set() for i in range(92)}
    for lo, mid, hi, node, at in runs.grammar(ids, off):
        for k, start in zip(node, at):  # every place of a symbol has the words of its first place
            size = hi[k] - lo[k]
            assert (ids[start : start + size] == ids[lo[k] : hi[k]]).all() and lo[k] < mid[k] < hi[k]
            held[start + mid[k] - lo[k]].add(size)
    assert all(len(held[i]) == (i not in (0, 42)) for i in held)  # each gap inside a text is one boundary


def test_periodic_runs_query_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "xé 中\x00 " * 8, "b " * 30_000, "a b\nc\td\x0be " * 40 + "z"]
    for _ in range(120):
        w = [f"w{rng.randint(0, rng.choice([3, 400]))}" for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(w * rng.choice([1, 1, 2, 3])))
    rows = [(i, t, "en", 1, [1]) for i, t in enumerate(texts)]
    rows += [(None, "q r s " * 9, None, None, None), rows[20], rows[20]]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long, collapsed array<int>").repartition(3)
    got = runs.run_digests(df)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(_answer(r[0], r[1]) for r in rows)
    assert runs.run_digests(df.where("false")).columns == got.columns and runs.run_digests(df.where("false")).count() == 0
    plain = {r.doc_id: r for r in runs.periodic_runs(df.where("doc_id in (4, 5)")).collect()}
    assert plain[4].runs == [] and [tuple(r) for r in plain[5].runs] == [(0, 12, 1)] and plain[5].collapsed == "a"


def test_periodic_runs_of_the_small_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 12000")
    assert collections.Counter(map(tuple, runs.run_digests(df).collect())) == collections.Counter(_answer(r.doc_id, r.text) for r in df.collect())


# ---- chat formatting ----------------------------------------------------------------------

PIECES = ["\\", "### ", "#", " ", "<", "|", "</turn>", ">", "/", "turn", "\n", ":", "a", "é", "<|image:0|>", "assistant"]


def test_turns_come_back_from_the_text():
    rng = random.Random(1)
    for _ in range(3_000):
        v, want = chat.PartVisitor(), []
        for t in range(rng.randint(0, 4)):
            role, parts, flat = rng.choice(["assistant", "user", "", "".join(rng.choices(PIECES, k=3))]), [], []
            for _ in range(rng.randint(0, 4)):
                if rng.random() < 0.7:
                    text = "".join(rng.choices(PIECES, k=rng.randint(0, 6)))
                    parts.append({"kind": rng.choice(["text", None]), "text": text})
                    if flat and isinstance(flat[-1], str):
                        flat[-1] += text
                    elif text:
                        flat.append(text)
                else:
                    kind = rng.choice(["image", "audio", "document", "video"])
                    parts.append({"kind": kind, "ref": "r"})
                    flat.append((kind if kind != "video" else "other", sum(isinstance(x, tuple) for _, c in want for x in c) + sum(isinstance(x, tuple) for x in flat)))
            v.turn(t, role, parts)
            want.append((role, flat))
        text, loss, attached = v.taken()
        assert list(chat.turns_of(text)) == want
        assert [chat.unescaped(text[a:b]) for a, b in loss] == [x for r, c in want if r == "assistant" for x in c if isinstance(x, str)]
        assert all(text[a["at"]:].startswith(f"<|{a['kind']}:{a['number']}|>") for a in attached)


@pytest.mark.parametrize("bad", ["x", "### user\n</turn>\n", "### user:\nhello", "### user:\na</turn>\n### ", "### user:\n<|image:x|></turn>\n"])
def test_texts_of_another_template_raise(bad):
    with pytest.raises(ValueError):
        list(chat.turns_of(bad))


def _chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", r"\### x </turn> <|image:0|>"), (2, None, None, None), (2, 3, "assistant", ""), (2, 3, "assistant", ""),
            (2, 2, "a\n### :\n", "<<|"), (None, 5, "assistant", "lost 中"), (3, 0, "assistant", "long \\ " * 50_000)]
    rows += [(4, t, ("user", "assistant")[t % 2], f"turn {t} " * 2_000) for t in range(200)]  # many rows' worth
    return [(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, chunk long"


def test_chat_digests_equal_brute_force(spark):
    rows, kind = _chats(spark)
    df = spark.createDataFrame(rows, kind).repartition(5)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    groups = collections.defaultdict(list)
    for c, t, r, x, *_ in rows + [(-7, 0, "user", chat.TRICKY_TEXT), (-7, 1, "assistant", chat.TRICKY_TEXT)]:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    want = {}
    for c, g in groups.items():
        g.sort()
        learned = "".join(x for *_, r, x in g if r == "assistant")
        chars = sum(len("### " + chat.escaped(r, True) + ":\n" + chat.escaped(x) + "</turn>\n") for *_, r, x in g)
        want[c] = (len(g), sha("".join(f"{r}\n{x}\n" for *_, r, x in g)), len(learned), sha(learned), chars, 0, 0)
    assert {r[0]: tuple(r)[1:] for r in chat.chat_digests(df).collect()} == want
    formatted = chat.format_chats(chat.with_tricky(df))
    assert {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg({"chunk": "count"}).toDF("conv_id", "n").collect()}[4] > 1
    shuffled = formatted.repartition(7, "formatted")
    assert {r[0]: tuple(r)[1:] for r in chat.read_back(shuffled).collect()} == want
    assert chat.format_chats(df.where("false")).count() == 0 and chat.chat_digests(df.where("false")).count() == 1


def test_parts_of_all_kinds(spark):
    part = lambda kind=None, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="i.png", w=57, h=28), part(None, "and <|"), part("image", ref=None), part("document", ref="d", p=3)]),
            (1, 1, "assistant", [part("text", "a"), part("audio", ref="s.wav", s=1.01), part("text", "b</tu"), part("text", "rn>")]), (2, 0, None, None), (2, 1, "user", [part("smell", ref="?")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chats(df, parts="parts").collect()}
    assert [(a.number, a.kind, a.ref, a.tokens, a.turn) for a in got[1].attachments] == [
        (0, "image", "i.png", 3, 0), (1, "image", None, 1, 0), (2, "document", "d", 3_000, 0), (3, "audio", "s.wav", 26, 1)]
    assert [(a.kind, a.tokens) for a in got[2].attachments] == [("other", 0)]
    assert list(chat.turns_of(got[1].formatted)) == [("user", ["see ", ("image", 0), "and <|", ("image", 1), ("document", 2)]), ("assistant", ["a", ("audio", 3), "b</turn>"])]
    assert [chat.unescaped(got[1].formatted[x.start : x.end]) for x in got[1].loss] == ["a", "b</turn>"]
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(df, parts="parts")).collect()}
    assert (back[1].n_attachments, back[1].attachment_tokens, back[1].loss_chars) == (4, 3_030, 9)


# ---- prefix trie --------------------------------------------------------------------------

def _nodes(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members, kids, leaves, saved = collections.defaultdict(list), collections.Counter(), collections.Counter(), collections.Counter()
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        kids[p[:-1]] += bool(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


@pytest.fixture(scope="module")
def conversations(spark):
    rng, rows = random.Random(3), []
    for c in range(50):
        for t in range(rng.choice([0, 1, 3, 9, 14, 25])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "é", ""])))
        if c % 7 == 0:
            rows.append((c, None, "system", "x" * 5_000))
    for c in range(100, 140):  # copies
        rows += [(c, 0, "user", "hi"), (c, 1, "assistant", "yo")]
    rows += [(9, 2**40, "user", "again")] * 3 + [(5, t, "user", f"{t}") for t in range(30, 130)]
    extra = [(None, 1, "user", "z")]
    return rows, spark.createDataFrame([(*r, "n", 0) for r in rows + extra], "conv_id long, turn long, role string, text string, hi string, pos long").repartition(4).cache()


@pytest.mark.parametrize("band,shard_rows", [(1_024, 2_048), (3, 20), (1, 9)])
def test_trie_equals_brute_force(conversations, band, shard_rows):
    rows, df = conversations
    assert collections.Counter(map(tuple, trie.rebuilt_trie(df, band, shard_rows).collect())) == _nodes(rows)


def test_trie_of_no_rows_and_of_plain_conversations(conversations):
    _, df = conversations
    assert trie.rebuilt_trie(df.where("false")).count() == 0
    plain = trie.prefix_trie(df.where("conv_id between 100 and 139"))
    assert sorted(tuple(r)[:7] for r in plain.collect()) == [(100, 0, None, 40, 1, 1, 39 * 4), (100, 1, 100, 40, 1, 1, 39 * 4), (100, 2, 100, 40, 0, 1, 39 * 2)]


def test_trie_of_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert collections.Counter(map(tuple, trie.rebuilt_trie(df).collect())) == _nodes([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_slots_are_a_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 40, (2_000, 2)), axis=0)
    table = trie.NodeTable(keys[:, 0].astype(np.int64), keys[:, 1].astype(np.int64))
    assert sorted(table.slots(keys[:, 0], keys[:, 1])) == list(range(len(keys)))
    assert (table.slots(keys[:, 0] + 100, keys[:, 1]) == -1).all()
    with pytest.raises(ValueError):
        trie.NodeTable(np.zeros(2, np.int64), np.zeros(2, np.int64))
