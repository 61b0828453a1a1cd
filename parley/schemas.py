"""Table schemas and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the evaluated pipeline's for equal results)
# ---------------------------------------------------------------------------
# Sentiment label domain and the digit codes models are asked to emit.
LABELS = ("negative", "neutral", "positive")
CODE_TO_LABEL = {-1: "negative", 0: "neutral", 1: "positive"}
# Dataset splits; "validation" is accepted as an alias of "valid".
SPLITS = ("training", "test", "valid")
SPLIT_ALIASES = {"validation": "valid"}
# Model registry, in registration order (model_no = position + 1).
MODEL_IDS = (
    "mistral 7b",
    "llama 3 8b",
    "gemma 7b",
    "falcon 7b",
    "deciLM 7b",
    "orca2 7b",
    "zephyr 7b beta",
)
# Summary prompt templates ({} is the dialogue), new-token budgets and the
# summary parse variant per model.
SUMMARY_PROMPTS = {
    "mistral 7b": ("Summarize the following dialogue:\n{}\nSummary:", 120, "rest"),
    "gemma 7b": ("Summarize the following dialogue:\n{}\n Summary:", 120, "first_line"),
    "llama 3 8b": ("Summarize this and generate only the summary::\n{}\nSummary:", 200, "first_line"),
    "mpt 7b": ("Summarize this and generate on the summary::\n{}\nSummary:", 200, "first_line"),
    "falcon 7b": ("Summarize this and generate only the summary:\n{}\nSummary:", 200, "first_line"),
    "zephyr 7b beta": ("Summarize this and generate only the summary:\n{}\nSummary:", 200, "first_line"),
    "orca2 7b": ("Summarize this and generate only the summary:\n{}\nSummary:", 200, "first_line"),
    "deciLM 7b": ("Summarize this and generate only the summary:\n{}\nSummary:", 200, "first_line"),
}
SENTIMENT_PROMPT = (
    "Given the following dialogue, output a single digit representing the sentiment label: "
    "-1 for negative, 0 for neutral, and 1 for positive. Do not provide any additional "
    " text or explanation.\n\n{}\n\nSentiment:"
)
SENTIMENT_PROMPT_ZEPHYR = (
    "Given the following dialogue, output a single digit representing the sentiment label: "
    "-1 for negative, 0 for neutral, and 1 for positive. Do not provide any additional "
    " text or explanation. \n\n{}\n\nSentiment:\n"
)
# Models with a sentiment prompt of their own.
SENTIMENT_PROMPTS = {"zephyr 7b beta": SENTIMENT_PROMPT_ZEPHYR}
# Chunking and batching defaults of the summary jobs.
MAX_DIALOGUE_CHARS = 1024
GENERATION_BATCH = 25
# Reading speed (words per minute) and group size of the corpus profile.
READING_WPM = 236
READERS = 4
# Fences of box statistics and outlier removal.
IQR_FACTOR = 1.5
# Teacher labelling: word limit and number of parts.
TEACHER_MAX_WORDS = 512
TEACHER_PARTS = 13
# METEOR parameters.
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5
# KDE grid.
KDE_POINTS, KDE_CUT = 200, 3.0
# Run-metric text format.
RUN_METRIC_FORMAT = "{name}: {value} MB"
# Whitespace: ASCII only, identical in Spark and in the DuckDB oracle.
WS_CLASS = "[ \\t\\n\\r\\f]"
WS_CHARS = " \t\n\r\f"
# ---------------------------------------------------------------------------

DIALOGUES = T.StructType([
    T.StructField("dialogue_id", T.LongType(), False),
    T.StructField("dataset", T.StringType(), False),
    T.StructField("dialogue_text", T.StringType(), False),
    T.StructField("actual_summary", T.StringType(), False),
    T.StructField("actual_sentiment", T.StringType(), True),
])
VARCHAR_LIMITS = {"dialogues": {"dataset": 10, "actual_sentiment": 8},
                  "models": {"model_id": 50},
                  "sentiments": {"generated_sentiment": 8}}

MODELS = T.StructType([
    T.StructField("model_id", T.StringType(), False),
    T.StructField("gpu_usage", T.IntegerType(), True),
    T.StructField("eval_time", T.IntegerType(), True),
])

_SCORE_COLS = ("rouge_1", "rouge_2", "rouge_l", "bert_precision", "bert_recall",
               "bert_f1", "meteor", "memory_summary_usage", "time_summary_taken")
SUMMARIES = T.StructType(
    [T.StructField("summary_id", T.LongType(), True),
     T.StructField("dialogue_id", T.LongType(), True),
     T.StructField("model_id", T.StringType(), True),
     T.StructField("generated_summary", T.StringType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in _SCORE_COLS])

SENTIMENTS = T.StructType([
    T.StructField("sentiment_id", T.LongType(), True),
    T.StructField("dialogue_id", T.LongType(), True),
    T.StructField("model_id", T.StringType(), True),
    T.StructField("generated_sentiment", T.StringType(), True),
    T.StructField("memory_sentiment_usage", T.DoubleType(), True),
    T.StructField("time_sentiment_taken", T.DoubleType(), True),
])

SENTIMENT_EVALUATION = T.StructType([
    T.StructField("evaluation_id", T.LongType(), True),
    T.StructField("model_id", T.StringType(), True),
    T.StructField("accuracy", T.DoubleType(), True),
    T.StructField("f1_score", T.DoubleType(), True),
])

TABLES = {
    "dialogues": DIALOGUES,
    "models": MODELS,
    "summaries": SUMMARIES,
    "sentiments": SENTIMENTS,
    "sentiment_evaluation": SENTIMENT_EVALUATION,
}
# Surrogate keys are generated on load, so a frame may omit them.
SURROGATE_KEYS = {"summaries": "summary_id", "sentiments": "sentiment_id",
                  "sentiment_evaluation": "evaluation_id"}
PRIMARY_KEYS = {"dialogues": "dialogue_id", "models": "model_id"}
FOREIGN_KEYS = {"summaries": [("dialogue_id", "dialogues"), ("model_id", "models")],
                "sentiments": [("dialogue_id", "dialogues"), ("model_id", "models")],
                "sentiment_evaluation": [("model_id", "models")]}

# Labelled CSV split (header: id, dialogue, summary, topic[, sentiment]).
DIALOGUE_CSV = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("dialogue", T.StringType(), True),
    T.StructField("summary", T.StringType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("sentiment", T.StringType(), True),
])

# Model result files: two header styles, normalised to style 1.
RESULT_STYLE_2 = {"Summary": "summary", "Time Taken (s)": "time_taken",
                  "GPU Usage (MB)": "memory_usage"}
RESULT_CSV = T.StructType([
    T.StructField("dialogue_id", T.LongType(), True),
    T.StructField("summary", T.StringType(), True),
    T.StructField("time_taken", T.DoubleType(), True),
    T.StructField("memory_usage", T.DoubleType(), True),
])

# Constraints of the five tables, as declared: (table, column, rule, value).
DECLARED = (
    ("dialogues", "dialogue_id", "primary_key", None),
    ("dialogues", "dataset", "not_null", None),
    ("dialogues", "dataset", "max_length", 10),
    ("dialogues", "dialogue_text", "not_null", None),
    ("dialogues", "actual_summary", "not_null", None),
    ("dialogues", "actual_sentiment", "max_length", 8),
    ("models", "model_id", "primary_key", None),
    ("models", "model_id", "max_length", 50),
    ("summaries", "summary_id", "primary_key", None),
    ("summaries", "dialogue_id", "foreign_key", "dialogues"),
    ("summaries", "model_id", "foreign_key", "models"),
    ("summaries", "model_id", "max_length", 50),
    ("sentiments", "sentiment_id", "primary_key", None),
    ("sentiments", "dialogue_id", "foreign_key", "dialogues"),
    ("sentiments", "model_id", "foreign_key", "models"),
    ("sentiments", "model_id", "max_length", 50),
    ("sentiments", "generated_sentiment", "max_length", 8),
    ("sentiment_evaluation", "evaluation_id", "primary_key", None),
    ("sentiment_evaluation", "model_id", "foreign_key", "models"),
    ("sentiment_evaluation", "model_id", "max_length", 50),
)
# Rules that the tables do not declare but the pipeline relies on.
LABEL_DOMAINS = (("dialogues", "actual_sentiment", "domain", LABELS), ("sentiments", "generated_sentiment", "domain", LABELS))
