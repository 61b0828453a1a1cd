"""Generation operator, prompts and size-checked broadcast."""

from pyspark.sql import functions as F

from parley.operators import generate as G


def test_generate_batches_of_25(spark):
    df = spark.range(0, 103).select(F.col("id"), F.concat(F.lit("h\nw"), F.col("id").cast("string")).alias("prompt"))
    out = G.generate(df.coalesce(1), G.LeadWords(1), batch_size=25).collect()
    assert sorted(r.output for r in out) == sorted(f"h\nw{i} w{i}" for i in range(103))
    # rows of one call share the per-row time (batch time / batch size)
    groups = {}
    for r in out:
        groups.setdefault(r.time_taken, []).append(r.id)
    assert sorted(len(v) for v in groups.values())[-1] <= 25
    assert all(r.memory_usage >= 0 for r in out)


def test_render_prompt_registry(spark):
    df = spark.createDataFrame([(1, "falcon 7b", "hi {x} 100%"), (2, "gemma 7b", "yo")],
                               "dialogue_id long, model_id string, dialogue_text string")
    r = {x.dialogue_id: x for x in G.render_prompt(df).collect()}
    assert r[1].prompt == "Summarize this and generate only the summary:\nhi {x} 100%\nSummary:"
    assert r[2].prompt == "Summarize the following dialogue:\nyo\n Summary:" and r[2].parse_variant == "first_line"


def test_lead_words_and_teacher(spark):
    assert G.LeadWords(3)(["head\n a  b c d"]) == ["head\n a  b c d a b c"]
    assert G.LengthTeacher()(["ab", "abc"]) == ["positive", "negative"]


def test_registry_prompts_need_no_join(spark):
    df = spark.createDataFrame([(1, "falcon 7b", "hi"), (2, "unknown", "hi")], "k int, model_id string, t string")
    out = G.render_prompt(df, text="t")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.k, "hi" in r.prompt) for r in out.collect()] == [(1, True)]
