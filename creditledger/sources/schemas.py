"""Schemas of the tables the operators expect. Read with these, never inferred."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(**columns):
    return StructType([StructField(name, type_()) for name, type_ in columns.items()])


# What the readers of dumps and logs give.
DUMP_LINES = _struct(
    file=StringType, commit_id=StringType, path=StringType, line_no=LongType,
    author=StringType, boundary=BooleanType, content=StringType,
)
HUNKS = _struct(
    commit_id=StringType, deleting_author=StringType, path=StringType, start=LongType, cnt=LongType,
)
RECORDS = _struct(file=StringType, split=LongType, seq=LongType, value=StringType)

_MAPPING = StructType(
    [
        StructField("canonical", StringType()),
        StructField("emails", ArrayType(StringType())),
        StructField("names", ArrayType(StringType())),
    ]
)

AUTHOR_CONFIG = StructType([StructField("authors", ArrayType(_MAPPING))])

# The driver's tables that the registered queries read.
DRIVER_TABLES = {
    "events": _struct(
        event_id=LongType, ts=TimestampNTZType, user_id=LongType, event_type=StringType,
        value=DoubleType, props=StringType,
    ),
    "documents": _struct(
        doc_id=LongType, text=StringType, lang=StringType, source=StringType, n_chars=LongType
    ),
    "labels": _struct(doc_id=LongType, quality=IntegerType, toxic=IntegerType),
    "customer": _struct(
        c_custkey=LongType, c_name=StringType, c_nationkey=IntegerType, c_acctbal=DoubleType,
        c_mktsegment=StringType,
    ),
    "orders": _struct(
        o_orderkey=LongType, o_custkey=LongType, o_orderstatus=StringType, o_totalprice=DoubleType,
        o_orderdate=TimestampNTZType, o_orderpriority=StringType,
    ),
    "lineitem": _struct(
        l_orderkey=LongType, l_partkey=LongType, l_suppkey=LongType, l_linenumber=IntegerType,
        l_quantity=DoubleType, l_extendedprice=DoubleType, l_discount=DoubleType, l_tax=DoubleType,
        l_returnflag=StringType, l_linestatus=StringType, l_shipdate=TimestampNTZType,
    ),
}
