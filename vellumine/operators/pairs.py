"""A table function over conversations: each answer with the question that it answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from vellumine.plans.scratch import ship

NEEDED = ("role", "text")


class Answers:
    """Of a table with role and text: for each turn of role assistant, the nearest user turn after the assistant turn before. Its key and order are named by the caller and may be of any type; the result has them in that type. The function itself says how its table is
    to be partitioned and ordered. A partition's rows pass one at a time and only the open question is held."""

    def __init__(self, made=None):
        self.question = None

    @staticmethod
    def analyze(row: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument) -> AnalyzeResult:
        if not row.isTable or not isinstance(row.dataType, StructType):
            raise ValueError("answers: the first argument must be a table")
        for name in (key, order):
            if not name.isConstantExpression or not isinstance(name.value, str):
                raise ValueError("answers: key and order must be constant names of columns")
        have = {f.name: f.dataType for f in row.dataType.fields}
        missing = [c for c in (key.value, order.value, *NEEDED) if c not in have]
        if missing:
            raise ValueError(f"answers: the table has no column {', '.join(missing)}")
        schema = StructType().add(key.value, have[key.value]).add("question_at", have[order.value]).add("answer_at", have[order.value]).add("question", have["text"]).add("answer", have["text"])
        quoted = [f"`{c.replace('`', '``')}`" for c in (key.value, order.value)]
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(quoted[0])], orderBy=[OrderingColumn(quoted[1], overrideNullsFirst=True), *(OrderingColumn(c, overrideNullsFirst=True) for c in NEEDED)])

    def eval(self, row, key: str, order: str):
        if row["role"] == "user":
            self.question = (row[order], row["text"])
        elif row["role"] == "assistant":
            if self.question is not None:
                yield row[key], self.question[0], row[order], self.question[1], row["text"]
            self.question = None


def register(spark: SparkSession, name: str = "answers") -> None:
    """Make the function known to SQL: select * from answers(table(t), 'conv_id', 'turn')."""
    ship(spark)
    spark.udtf.register(name, udtf(Answers))


def answers(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, question_at, answer_at, question and answer of every assistant turn that follows a user turn; of several user turns in a row the last is the question, of several assistant turns the first the answer.

    Cases: rows of one place in the order come by role and then text; a null place comes first; rows with a null key are one conversation; null or other roles neither ask nor answer; null texts stay null; extra columns are ignored; an empty table gives no rows.
    """
    spark = turns.sparkSession
    register(spark)
    return spark.sql("select * from answers(table(select * from {turns}), :key, :order)", {"key": key, "order": order}, turns=turns.select(key, order, *NEEDED))
