import hashlib
import re

import pytest
from llm_cases import HARD, PROSE, texts
from pyspark.sql import functions as F


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items):
    w, found = words(text), set()
    hit = [0] * len(w)
    for item, t in items:
        p = words(t)
        m = min(13, len(p))
        for k in range(len(p) - m + 1) if p else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == p[k : k + m]:
                    hit[i : i + m] = [1] * m
                    if item is not None:
                        found.add(str(item))
    if any(i is None for i, _ in items):
        return None
    names = sorted(found)
    return len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)


ITEMS = [(1, PROSE), (2, "one two"), (2, "ab"), (3, None), (4, "..."), (10, "a a a"), (5, "jumps OVER the lazy dog, while seven wise owls watch from a tall"), (6, PROSE), (7, "wort"), (8, "Größe straße über")]


@pytest.mark.parametrize("block_windows", [10, 200_000])
def test_decontaminate(spark, hard, none, block_windows):
    from riskloom.llm.decontaminate import decontaminate

    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate(hard, bench, block_windows=block_windows).collect()
    assert len(got) == len(HARD)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(texts()[r.doc_id], ITEMS), r.doc_id
        assert r.score == "score"
    assert decontaminate(none, bench).collect() == []
    assert not decontaminate(hard, bench.limit(0)).filter("n_hit > 0 or contaminated").count()
    unnamed = decontaminate(hard, spark.createDataFrame([(None, "one two")], "item_id long, text string")).filter("n_hit > 0").collect()
    assert {(r.doc_id, r.n_hit, r.n_items) for r in unnamed} == {(8, 2, 0), (9, 2, 0)}


TURNS = [
    (1, 2, "assistant", "</s>[INST] x \\ [/INST] <s>\\"), (1, 1, "user", "\\[INST]\n\n<s>"), (1, 3, "user", None), (1, 4, "assistant", "é\U0001f600 a\tb"),
    (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 1, None, "hi"), (3, None, "od\nd<s> role", "x" * 50_000), (None, 1, "user", "no id"), (4, 1, "system", "s"), (4, 2, "assistant", "<\\s>[\\INST]\\\\"),
]


def test_chat(spark):
    from riskloom.llm import chat_format
    from riskloom.llm.chat_format import digests, expand, format_conversations, read_turns, unescaped, with_strings

    rows = spark.createDataFrame([(*r, "c", 1) for r in TURNS], "conv_id long, turn long, role string, text string, formatted string, pos int")
    formatted = format_conversations(rows)
    convs = {}
    for c, t, r, x in sorted(TURNS, key=lambda v: (v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    back = {}
    for r in read_turns(formatted).orderBy("pos").collect():
        back.setdefault(r.conv_id, []).append((r.role, r.text))
    assert back == convs
    strings = {r.conv_id: r.formatted for r in formatted.collect()}
    for r in digests(formatted).collect():
        turns = convs[r.conv_id]
        loss = "".join(x for a, x in turns if a == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(strings[r.conv_id]))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    examples = with_strings(expand(formatted), formatted).withColumn("read", unescaped(F.expr("substring(example, start + 1, end - start)"))).collect()
    assert len(examples) == sum(a == "assistant" for turns in convs.values() for a, _ in turns)
    for e in examples:
        assert strings[e.conv_id].startswith(e.example) and e.read == e.target == convs[e.conv_id][e.n_context][1]
        assert e.example.count("<s>") == e.n_context + 1 and e.example.endswith("</s>")
    # A mask that is off by one character shows in the digests.
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chat_format, "END", "</s>!")
        wrong = digests(formatted).collect()
    right = {r.conv_id: r.loss_sha256 for r in digests(formatted).collect()}
    assert [r.conv_id for r in wrong if r.loss_sha256 != right[r.conv_id]] == [1]
    assert format_conversations(rows.limit(0)).collect() == [] and digests(format_conversations(rows.limit(0))).collect() == []


def test_pipeline(spark, tmp_path, hard):
    import corpus_pipeline
    from test_counting import tiktoken_encoder
    from test_dedup import brute_exact, brute_near

    long = " ".join(f"term{k}" for k in range(200))
    extra = [(20, long, "en"), (21, long.replace("term50", "other"), "en"), (22, "harmless words of its own kind", "en"), (23, "intro " + PROSE + " outro", "en")]
    docs = hard.filter("doc_id is not null").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "jumps over the lazy dog while seven wise owls watch from a tall old oak near the river")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    stays = {r[0] for r in brute_exact(rows) if r[3]}
    rows = [r for r in rows if r[0] in stays]
    stays = {r[0] for r in brute_near(rows) if r[3]}
    rows = [(i, t) for i, t in rows if i in stays and not brute_hits(t, items)[4]]
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: (len(tiktoken_encoder().encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    assert {20, 22} <= set(got) and 21 not in got and 23 not in got
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, stage, str(tmp_path)).columns == stage.columns, name


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_chat_goes_through_examples(spark, monkeypatch):
    """The registered columns come from the expanded examples: a wrong context or a missing example shows in them."""
    from riskloom.llm import chat_format
    from riskloom.llm.chat_format import digests, format_conversations

    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    formatted = format_conversations(rows)
    made = {}
    for e in chat_format.examples(formatted).orderBy("pos").collect():
        made.setdefault(e.conv_id, []).append(e)
    strings = {r.conv_id: r.formatted for r in formatted.collect()}
    assert made.keys() == strings.keys()
    for conv, whole in strings.items():
        segments = whole.split("<s>")[1:]
        replies = [k for k, s in enumerate(segments, 1) if s.startswith("assistant\n")]
        ends = sorted({*replies, len(segments)})
        assert [(e.pos, e.n_context, e.example) for e in made[conv]] == [(k, k - 1, "".join(f"<s>{s}" for s in segments[:k])) for k in ends]
        assert [e.pos for e in made[conv] if e.target is not None] == replies and [e.pos for e in made[conv] if e.last] == [len(segments)]
    right = {r.conv_id: r for r in digests(formatted).collect()}
    prefixes = chat_format.prefixes

    def without_first(given):
        return prefixes(given).withColumn("example", F.when(F.col("pos") > 1, F.expr("substring(example, locate('<s>', example, 2))")).otherwise(F.col("example")))

    monkeypatch.setattr(chat_format, "prefixes", without_first)
    wrong = {r.conv_id: r for r in digests(formatted).collect()}
    assert {c for c in right if wrong[c].turns_sha256 != right[c].turns_sha256} == {c for c, e in made.items() if e[-1].pos > 1}
    monkeypatch.setattr(chat_format, "prefixes", lambda given: prefixes(given).filter("pos <> 2 or last"))
    lost = {r.conv_id: r for r in digests(formatted).collect()}
    assert [c for c in right if lost[c].loss_sha256 != right[c].loss_sha256] == [1]
