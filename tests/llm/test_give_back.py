from pathlib import Path

from pyspark.sql import functions as F

PIECE = 100_000  # below the size that the C library takes from the system by itself


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_a_task_gives_its_memory_back():
    """What a task has freed goes back to the system, also below a block that stays."""
    from riskloom.llm.rows import giving_back

    stays = []

    def run(batches):
        held = [b"x" * (PIECE + k % 2) for k in range(2500)]
        stays.append(b"y" * PIECE)
        yield from batches
        assert len(held) == 2500

    before = resident()
    assert list(giving_back(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 100 << 20


def test_workers_are_small_after_operators(spark, hard):
    """The operators' Arrow functions all end in giving back: their plans' functions carry it to the workers."""
    from riskloom.llm import decontaminate, exact_dedup, near_dedup, rows

    assert all(m.giving_back is rows.giving_back for m in (decontaminate, exact_dedup, near_dedup))
    run, _ = near_dedup._pairs(lambda batches: iter(()), hard.schema["doc_id"].dataType)
    assert run.__qualname__.startswith("giving_back")
    made = rows.map_texts(hard.select("doc_id", "text"), lambda: lambda texts: [[len(t or b"") for t in texts]], [("n", hard.schema["doc_id"].dataType)], carry=["doc_id"], text="text")
    want = hard.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    assert sorted(map(str, made.collect())) == sorted(f"Row(doc_id={r[0]}, n={r[1]})" for r in want.collect())


def test_paths_of_large_groups_are_short():
    """Merging a group pair by pair keeps its paths short; the pairs that merge are those that connect something new."""
    from riskloom.llm.near_dedup import _Forest

    class Counted(_Forest):
        steps = 0

        def __contains__(self, x):
            Counted.steps += 1
            return super().__contains__(x)

    n, forest = 200, Counted()
    merged = [(a, b) for a in range(n) for b in range(n) if a != b and forest.merge(a, b)]
    assert merged == [(0, b) for b in range(1, n)] and len({forest.root(a) for a in range(n)}) == 1
    assert Counted.steps < 8 * n * n


def test_known_words_are_packed_between_tasks(spark, hard, monkeypatch):
    """A task leaves what it knows of words as one value, and the next one asks the database for new words only."""
    from riskloom.llm import byte_bpe

    made, asked, code = [], [], byte_bpe.Codec.code
    monkeypatch.setattr(byte_bpe, "map_texts", lambda docs, make, fields, **more: made.append(make))
    monkeypatch.setattr(byte_bpe, "_WORDS", {})
    monkeypatch.setattr(byte_bpe.Codec, "code", lambda self, words: asked.append(sorted(words)) or code(self, words))
    byte_bpe.encode_texts(hard.select("doc_id", "text"))
    first = made[0]()
    want = first([b"plain words twice", None])
    first.end()
    assert [type(x) for x in byte_bpe._WORDS.values()] == [bytes]
    second = made[0]()
    assert second([b"plain words twice", None]) == want
    second([b"plain words again"])
    assert asked[1] == [] and asked[2] == [b" again"]


def test_words_asked_for_again_stay():
    from riskloom.llm.byte_bpe import Words

    words = Words(limit=4)
    for some in ({"a", "b", "c"}, {"a", "d", "e"}):
        words.update((w, (b"", w.encode())) for w in words.missing(some))
    assert len(words) == 5
    words.trim()
    assert dict(words) == {"a": (b"", b"a")} and words.again == set()
    assert dict(Words(words.packed())) == dict(words)
