"""Reading instruction rows and submissions, and the built-in small tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codelens import schemas
from codelens.functions import text, vocab

MALFORMED = "line string, reason string"

# Evaluation cases: category, task, input, keywords, difficulty, what it tries.
# Categories, inputs, keywords and difficulties. Texts are ours.
CASES = [
    ("Basic Functions", "Define a function returning n factorial", "",
     ["def", "factorial", "return"], "easy", "Recursion or a simple loop"),
    ("Basic Functions", "Define a function that tells whether n is prime", "",
     ["def", "prime", "return", "for"], "easy", "Loop over divisors"),
    ("Basic Functions", "Define a function that turns a text around", "",
     ["def", "reverse", "return"], "easy", "Handling of text"),
    ("Data Structures", "Build a stack type that can push, pop and peek", "",
     ["class", "Stack", "push", "pop", "peek"], "medium", "A container with three methods"),
    ("Data Structures", "Build a search tree type that can insert and search", "",
     ["class", "BinarySearchTree", "insert", "search"], "hard", "Ordered tree"),
    ("Data Structures", "Build a queue out of a pair of stacks", "",
     ["class", "Queue", "enqueue", "dequeue", "stack"], "medium", "One container by two others"),
    ("Algorithms", "Find a value in a sorted list by halving", "[1, 3, 5, 7, 9, 11, 13, 15]",
     ["def", "binary_search", "while", "return"], "medium", "Logarithmic lookup"),
    ("Algorithms", "Order a list with quicksort", "",
     ["def", "quicksort", "partition", "return"], "hard", "Divide and conquer"),
    ("Algorithms", "Compute Fibonacci numbers from a table of earlier ones", "",
     ["def", "fibonacci", "dp", "return"], "medium", "Reuse of partial results"),
    ("OOP", "Build a calculator type for the four basic operations", "",
     ["class", "Calculator", "add", "subtract", "multiply", "divide"], "easy", "Type with methods"),
    ("OOP", "Build a bank account type that tracks its balance", "",
     ["class", "BankAccount", "deposit", "withdraw", "balance"], "medium", "State behind methods"),
    ("OOP", "Derive dogs and cats from a common animal type", "",
     ["class", "Animal", "Dog", "Cat", "inherit"], "medium", "Inheritance"),
    ("Advanced", "Build a decorator that reports how long a call takes", "",
     ["def", "decorator", "time", "wrapper"], "hard", "Function wrapping a function"),
    ("Advanced", "Build a context manager that opens and closes a file", "",
     ["class", "__enter__", "__exit__", "with"], "hard", "Enter and exit protocol"),
    ("Advanced", "Yield Fibonacci numbers one at a time", "",
     ["def", "yield", "fibonacci", "generator"], "medium", "Lazy sequence"),
    ("Practical", "Check with a pattern whether a text is a mail address", "",
     ["def", "email", "regex", "re", "return"], "medium", "Validation"),
    ("Practical", "Turn CSV text into a list of records", "",
     ["def", "csv", "parse", "return"], "medium", "Text to records"),
    ("Practical", "Fetch a page with requests and pick out its content", "https://example.com",
     ["import", "requests", "def", "scrape"], "medium", "Reading a web page"),
    ("Error Handling", "Divide two numbers without failing on zero", "",
     ["def", "try", "except", "ZeroDivisionError"], "easy", "Catching an error"),
]


def _read(spark: SparkSession, path: str, schema, fmt: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that do not, with a reason.

    Only text formats have such lines. Blank ones are no rows and not refused.
    """
    if fmt != "json":
        return spark.read.schema(schema).format(fmt).load(path), spark.createDataFrame([], MALFORMED)
    bad = "_malformed"
    wide = StructType([*schema.fields, StructField(bad, StringType())])
    lines = spark.read.text(path).filter(~text.is_blank(F.col("value")))
    parsed = lines.select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": bad}).alias("row"))
    fits = F.col("row").isNotNull() & F.col(f"row.{bad}").isNull()
    refused = parsed.filter(~fits).select(F.col("value").alias("line"), F.lit("malformed").alias("reason"))
    return parsed.filter(fits).select("row.*").drop(bad), refused


def read_instructions(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Instruction rows with ``row_id`` from Parquet or JSON Lines files, and refused lines."""
    return _read(spark, path, schemas.INSTRUCTIONS, fmt)


def read_submissions(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Submissions from Parquet or JSON Lines files, and refused lines."""
    return _read(spark, path, schemas.SUBMISSIONS, fmt)


def _small_table(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A table held in the plan itself, so that Spark knows how small it is.

    Made from plain rows it would be a scan of unknown size, and every join with
    it would shuffle the other side.
    """
    columns = dict(zip(schema.names, map(list, zip(*rows))))
    return spark.createDataFrame(pa.table(columns)).to(schema)


def builtin_cases(spark: SparkSession) -> DataFrame:
    """The 19 evaluation cases, numbered from 0."""
    return _small_table(spark, [(number, *case) for number, case in enumerate(CASES)], schemas.CASES)


def categories(spark: SparkSession) -> DataFrame:
    """The seven submission categories in display order."""
    rows = [(at, name, title) for at, (name, title) in enumerate(vocab.CATEGORIES.items(), 1)]
    return _small_table(spark, rows, schemas.CATEGORY_TABLE)
