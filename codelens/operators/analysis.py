"""What the parser found, and the safety scan over it.

The parser runs once per row and does not know the scan policy: it lists what
the code imports, calls and accesses in visiting order. Policies are applied to
that list with array expressions, so stored analyses can be scanned again under
another policy without parsing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import python_ast, text, vocab
from codelens.plans.layout import settle

ANALYSIS = "analysis"


@dataclass(frozen=True)
class Policy:
    """Which imports the scan exempts beyond the default allow list."""

    allow_imports: tuple[str, ...] = ()
    enable_networking: bool = False

    @property
    def allowed(self) -> tuple[str, ...]:
        network = vocab.NETWORK_IMPORTS if self.enable_networking else ()
        return vocab.ALLOWED_IMPORTS + tuple(self.allow_imports) + network

    @property
    def refused(self) -> tuple[str, ...]:
        """Blocked imports that nothing exempts; names on no list pass."""
        return tuple(name for name in vocab.BLOCKED_IMPORTS if name not in self.allowed)


def analyse(df: DataFrame, code: str = "generated_code") -> DataFrame:
    """Adds the ``analysis`` struct.

    Put filters on other columns before this call: no filter is moved below it.
    """
    return df.withColumn(ANALYSIS, python_ast.analysis(text.or_empty(F.col(code))))


def analyse_distinct(df: DataFrame, code: str = "generated_code") -> DataFrame:
    """As ``analyse``, but each distinct text of the whole table is parsed once.

    It costs two shuffles of the texts, so it only pays where most rows repeat a
    text of another task; a task's batches parse a repeated text once anyway.
    The parsed texts are stored, so that a text many rows share can be split.
    """
    keyed = df.withColumn("_distinct_code", text.or_empty(F.col(code)))
    parsed = settle(analyse(keyed.select("_distinct_code").distinct(), "_distinct_code"))
    return keyed.join(parsed, "_distinct_code").drop("_distinct_code")


def features(analysed: DataFrame) -> DataFrame:
    """The analysis fields as columns next to the others."""
    return analysed.select(
        *[name for name in analysed.columns if name != ANALYSIS],
        F.col(f"{ANALYSIS}.status").alias("parse_status"),
        F.col(f"{ANALYSIS}.error").alias("parse_error"),
        (F.col(f"{ANALYSIS}.status") == python_ast.OK).alias("syntax_valid"),
        *[f"{ANALYSIS}.{name}" for name in
          ("has_function", "has_class", "has_import", "n_names", "n_meaningful")],
    )


def names_of(kind: str) -> Column:
    """Sorted names of one finding kind: import, call or attribute."""
    chosen = F.filter(F.col(f"{ANALYSIS}.findings"), lambda found: found["kind"] == kind)
    return F.array_sort(F.transform(chosen, lambda found: found["name"]))


def inventory(analysed: DataFrame) -> DataFrame:
    """Adds the sorted arrays of imported modules, called names and attributes."""
    return analysed.withColumns({
        "imports": names_of("import"),
        "calls": names_of("call"),
        "attributes": names_of("attribute"),
    })


def _literals(names: Iterable[str]) -> Column:
    return F.array(*[F.lit(name) for name in names]).cast("array<string>")


def blocked_imports(imports: Column, policy: Policy = Policy()) -> Column:
    return F.array_except(F.array_intersect(imports, _literals(vocab.BLOCKED_IMPORTS)), _literals(policy.allowed))


def blocked_calls(calls: Column) -> Column:
    return F.array_intersect(calls, _literals(vocab.BLOCKED_BUILTINS))


def blocked_attributes(attributes: Column) -> Column:
    return F.array_intersect(attributes, _literals(vocab.BLOCKED_ATTRIBUTES))


def first_violation(policy: Policy = Policy()) -> Column:
    """The message of the first finding the policy refuses, else null."""

    def refused(found: Column) -> Column:
        kind, name = found["kind"], found["name"]
        return (
            ((kind == "import") & name.isin(*policy.refused))
            | ((kind == "call") & name.isin(*vocab.BLOCKED_BUILTINS))
            | ((kind == "attribute") & name.isin(*vocab.BLOCKED_ATTRIBUTES))
        )

    hit = F.get(F.filter(F.col(f"{ANALYSIS}.findings"), refused), F.lit(0))
    message = (
        F.when(hit["kind"] == "import", F.lit(vocab.BLOCKED_IMPORT_TEXT))
        .when(hit["kind"] == "call", F.lit(vocab.BLOCKED_BUILTIN_TEXT))
        .when(hit["kind"] == "attribute", F.lit(vocab.BLOCKED_ATTRIBUTE_TEXT))
    )
    found = F.concat(message, hit["name"])
    status = F.col(f"{ANALYSIS}.status")
    return F.when(
        status == python_ast.SYNTAX, F.concat(F.lit(vocab.SYNTAX_ERROR), F.col(f"{ANALYSIS}.error"))
    ).otherwise(found)


def scan(analysed: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds ``violation``, ``is_safe`` and the ``scan_error`` text, null if safe.

    Code that does not parse is refused; code the parser gave up on for another
    reason has no violation but is not safe either.
    """
    gave_up = F.col(f"{ANALYSIS}.status") == python_ast.OTHER
    checked = analysed.withColumn("violation", first_violation(policy))
    return checked.withColumns({
        "is_safe": F.col("violation").isNull() & ~gave_up,
        "scan_error": F.when(
            gave_up, F.concat(F.lit(vocab.SANDBOX_PREFIX), F.col(f"{ANALYSIS}.error"))
        ).otherwise(F.concat(F.lit(vocab.SECURITY_PREFIX), F.col("violation"))),
    })


def usage_counts(analysed: DataFrame) -> DataFrame:
    """In how many code rows each module, called name and attribute occurs."""
    found = analysed.select(F.explode(f"{ANALYSIS}.findings").alias("found"))
    return found.groupBy(
        F.col("found.kind").alias("kind"), F.col("found.name").alias("name")
    ).agg(F.count("*").alias("n_rows"))


def violation_counts(scanned: DataFrame) -> DataFrame:
    """How many code rows each violation refuses first."""
    return (
        scanned.filter(F.col("violation").isNotNull())
        .groupBy("violation")
        .agg(F.count("*").alias("n_rows"))
    )
