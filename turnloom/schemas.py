"""Data model: the shapes every operator reads and writes."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, INT, LONG, DOUBLE, BOOL = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
)

# Dialogue
LINE = _struct(speaker=STRING, text=STRING, scene=INT)
EPISODE = _struct(title=STRING, url=STRING, lines=T.ArrayType(LINE))
MESSAGE = _struct(role=STRING, content=STRING)
MESSAGES = T.ArrayType(MESSAGE)
PAIR_META = _struct(episode=STRING, scene=INT, target_words=INT)
PAIR = _struct(messages=MESSAGES, meta=PAIR_META)

# Similarity evaluation
GENERATION = _struct(text=STRING, tokens=INT, hit_token_limit=BOOL)
GENERATION_ROW = _struct(
    index=LONG, episode=STRING, prompt=MESSAGES, reference=STRING,
    base=GENERATION, sft=GENERATION,
)

# Multiple choice
QUESTION = _struct(question=STRING, choices=T.ArrayType(STRING), answer=INT)
SUBJECT_ITEMS = _struct(subject=STRING, dev=T.ArrayType(QUESTION), test=T.ArrayType(QUESTION))
CHOICE_DATA = _struct(dataset=STRING, revision=STRING, subjects=T.ArrayType(SUBJECT_ITEMS))
SELECTION = _struct(dev_indices=T.ArrayType(INT), test_indices=T.ArrayType(INT))
CHOICE_MANIFEST = _struct(
    dataset=STRING, revision=STRING, split=STRING, shots=INT,
    subjects=T.MapType(STRING, SELECTION), data_sha256=STRING,
)
CHOICE_EXAMPLE = _struct(subject=STRING, index=INT, messages=MESSAGES, answer=STRING)
PREDICTION = _struct(
    prediction=STRING, choice_probabilities=T.MapType(STRING, DOUBLE),
    answer_letter_probability_mass=DOUBLE, unconstrained_top_token=STRING,
)
CHOICE_PREDICTION = T.StructType(
    CHOICE_EXAMPLE.fields + [T.StructField("base", PREDICTION), T.StructField("sft", PREDICTION)]
)
