"""Chat formatting against plain Python: digests, masks, attention and sharing."""

import hashlib

from tidemark.llm import chat
from tidemark.llm.common import new_path

A, U, S = "assistant", "user", "system"
ODD = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST]", "a\\\\</s>\\", "<<s>>[[/INST]]", "", None, "é日\U0001f600\x00\n", "[INST", "s>", "<s", "x" * 5000]


def sample():
    rows = []
    for i, x in enumerate(ODD):
        rows += [(i, 0, U, x), (i, 1, A, ODD[-1 - i]), (i, 2, x, x)]
    for i in range(40):  # a shared start, and branches at several depths
        rows += [(100 + i, 0, S, "be kind"), (100 + i, 1, U, f"q{i % 3}"), (100 + i, 2, A, f"a{i % 6}"), (100 + i, 3, U, f"u{i}")]
    rows += [(200 + i, k, r, t) for i in range(30) for k, (r, t) in enumerate([(S, "be kind"), (U, "same"), (A, "copy")])]
    rows += [(300, 0, S, "be kind"), (301, 5, A, "z"), (301, 5, A, "z"), (301, None, A, "last"), (None, 0, U, "no id"), (302, 0, None, None)]
    rows += [(400, k, (U, A)[k % 2], f"t{k}") for k in range(300)]
    return rows


def conversations(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


def wrote(role, text):
    def esc(x):
        x = x.replace("\\", "\\\\")
        for s in ("<s>", "</s>", "[INST]", "[/INST]"):
            x = x.replace(s, s[0] + "\\" + s[1:])
        return x

    return f"<s>[INST] {esc(role)} [/INST]{esc(text)}</s>"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, pack string")


def test_round_trip_and_masks(spark):
    want = conversations(sample())
    for size in (300, 4000, 1 << 18):
        path = new_path(spark, "chats")
        chat.write_chats(frame(spark, sample()), path, size)
        got = {r.conv_id: r for r in chat.read_chats(spark, path).collect()}
        assert set(got) == set(want)
        for c, turns in want.items():
            loss = "".join(t for r, t in turns if r == A)
            r = got[c]
            assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in turns).encode()).hexdigest()
            assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert r.formatted_chars == sum(len(wrote(x, t)) for x, t in turns)
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.pack, r.segment))
        for pack in {r.pack for r in rows}:
            own = [r for r in rows if r.pack == pack]
            nodes = [r for r in own if not r.leaf]
            text, positions, masks, learned = chat.expanded(nodes)
            assert [r.segment for r in own] == list(range(len(own)))
            assert len({(r.parent, r.text) for r in nodes}) == len(nodes)  # a shared turn stands once in a pack
            by = {r.segment: r for r in nodes}
            for leaf in (r for r in own if r.leaf):
                chain, k = [], leaf.parent
                while k >= 0:
                    chain.append(by[k])
                    k = by[k].parent
                turns = want[leaf.conv_id]
                assert [n.text for n in reversed(chain)] == [wrote(x, t) for x, t in turns]
                at = [i for n in reversed(chain) for i in range(n.start, n.start + len(n.text))]
                assert [positions[i] for i in at] == list(range(len(at)))
                assert chat.plain("".join(text[i] for i in at if learned[i])) == "".join(t for r, t in turns if r == A)
                for p in (0, len(at) // 2, len(at) - 1) if at else ():  # what a character sees is what comes before it in its conversation
                    assert [i for a, b in masks[at[p]] for i in range(a, b)] == at[: p + 1]


def test_shared_turns_are_written_once(spark):
    path = new_path(spark, "chats")
    rows = [(i, k, (U, A)[k % 2], f"same {k}" if k < 6 else f"own {i}") for i in range(200) for k in range(7)]
    chat.write_chats(frame(spark, rows), path)
    nodes = [r for r in spark.read.parquet(path).collect() if not r.leaf]
    assert len({r.pack for r in nodes}) <= 4 and len(nodes) <= 200 + 6 * 4
    chat.write_chats(frame(spark, [(i, 0, U, "copy") for i in range(5000)]), path + "x", 1000)
    sizes = spark.read.parquet(path + "x").groupBy("pack").count().collect()
    assert max(r["count"] for r in sizes) <= 17  # copies do not pile up in one pack


def test_no_conversations(spark):
    path = new_path(spark, "chats")
    chat.write_chats(frame(spark, []), path)
    assert chat.read_chats(spark, path).count() == 0
