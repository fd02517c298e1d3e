"""Fixed relation schemas."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("root", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
    ]
)

HEADING_PATH = T.ArrayType(T.StringType(), False)

PIECES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("root", T.StringType(), False),
        T.StructField("heading_path", HEADING_PATH, False),
        T.StructField("text", T.StringType(), False),
        T.StructField("line_start", T.LongType(), False),
        T.StructField("line_end", T.LongType(), False),
    ]
)

CHUNKS = T.StructType([T.StructField("id", T.LongType(), False), *PIECES.fields])

FORWARD = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("doc_len", T.DoubleType(), False),
        T.StructField("terms", T.ArrayType(T.StringType(), False), False),
        T.StructField("tfs", T.ArrayType(T.DoubleType(), False), False),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    ]
)

RANKED = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("score", T.DoubleType(), False),
    ]
)

EMBEDDING_CACHE = T.StructType(
    [
        T.StructField("text_hash", T.StringType(), True),
        T.StructField("dim", T.IntegerType(), True),
        T.StructField("embedding", T.ArrayType(T.FloatType(), True), True),
    ]
)

HITS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("heading_path", HEADING_PATH, False),
        T.StructField("line_start", T.LongType(), False),
        T.StructField("line_end", T.LongType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("snippet", T.StringType(), False),
        T.StructField("chunks_matched", T.LongType(), False),
    ]
)
