"""Declared schemas of the tables that cross operator boundaries."""

from pyspark.sql import types as T

# Vector widths of the two index columns.
EMBEDDING_DIMS = 1536
EMBEDDING_LOCAL_DIMS = 1024

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("item_key", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("atk", T.IntegerType()),
        T.StructField("def_", T.IntegerType()),
        T.StructField("english_attribute", T.StringType()),
        T.StructField("properties", T.ArrayType(T.StringType())),
        T.StructField("content", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_local", T.ArrayType(T.FloatType())),
    ]
)

QUERY_SCHEMA = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("min_atk", T.LongType()),
        T.StructField("max_atk", T.LongType()),
        T.StructField("min_def", T.LongType()),
        T.StructField("max_def", T.LongType()),
        T.StructField("level", T.LongType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("card_type", T.StringType()),
        T.StructField("limit", T.IntegerType()),
    ]
)

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("src_path", T.StringType()),
        T.StructField("dest_path", T.StringType()),
        T.StructField("is_directory", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

VECTOR_COLUMNS = ("embedding", "embedding_local")
