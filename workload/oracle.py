"""The same queries as DuckDB SQL, written from the rules, not from the Spark code.

DuckDB cannot parse Python. For submissions the template number says what the
parser finds; everything else is computed from the text.
"""

from __future__ import annotations

from workload.templates import (
    CATEGORIES,
    FREE_CASE,
    GENERATION_ERROR,
    INSTRUCTIONS,
    N_CASE_NUMBERS,
    OUTCOMES,
    TEMPLATES,
)

# Fixed values, stated here once more so that a wrong word on one side shows: what
# counts as blank, the known categories, the concepts, the refused names, the cases.
BLANK_POINTS = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200,
 8201, 8202, 8232, 8233, 8239, 8287, 12288)
KNOWN_CATEGORIES = ('functions', 'classes', 'algorithms', 'web', 'data', 'advanced', 'general')
CONCEPTS = {'function': ['def ', 'function'],
 'class': ['class ', 'object'],
 'loop': ['for ', 'while ', 'loop'],
 'condition': ['if ', 'elif ', 'else:', 'condition'],
 'list': ['list', 'array', '[]'],
 'dict': ['dict', 'dictionary', '{}'],
 'file': ['file', 'open(', 'read', 'write'],
 'sort': ['sort', 'sorted'],
 'search': ['search', 'find', 'index'],
 'calculate': ['calculate', 'compute', '+', '-', '*', '/'],
 'return': ['return'],
 'print': ['print(']}
BLOCKED_IMPORTS = ('os', 'subprocess', 'sys', 'shutil', 'glob', 'socket', 'urllib', 'requests', 'http', 'ftplib', 'smtplib',
 'telnetlib', 'webbrowser', 'ctypes', 'multiprocessing', 'threading', 'asyncio', 'concurrent', 'importlib',
 '__import__', 'eval', 'exec', 'compile', 'open', 'file', 'input', 'raw_input')
BLOCKED_BUILTINS = ('eval', 'exec', 'compile', '__import__', 'open', 'file', 'input', 'raw_input', 'reload', 'vars', 'locals',
 'globals', 'dir', 'getattr', 'setattr', 'delattr', 'hasattr')
BLOCKED_ATTRIBUTES = ('__class__', '__bases__', '__subclasses__', '__mro__', '__globals__', '__code__', '__func__', '__self__',
 '__module__', '__dict__')
# Category, task, keywords, difficulty.
CASES = [('Basic Functions', 'Define a function returning n factorial', ['def', 'factorial', 'return'], 'easy'),
 ('Basic Functions', 'Define a function that tells whether n is prime', ['def', 'prime', 'return', 'for'],
  'easy'),
 ('Basic Functions', 'Define a function that turns a text around', ['def', 'reverse', 'return'], 'easy'),
 ('Data Structures', 'Build a stack type that can push, pop and peek',
  ['class', 'Stack', 'push', 'pop', 'peek'], 'medium'),
 ('Data Structures', 'Build a search tree type that can insert and search',
  ['class', 'BinarySearchTree', 'insert', 'search'], 'hard'),
 ('Data Structures', 'Build a queue out of a pair of stacks',
  ['class', 'Queue', 'enqueue', 'dequeue', 'stack'], 'medium'),
 ('Algorithms', 'Find a value in a sorted list by halving', ['def', 'binary_search', 'while', 'return'],
  'medium'),
 ('Algorithms', 'Order a list with quicksort', ['def', 'quicksort', 'partition', 'return'], 'hard'),
 ('Algorithms', 'Compute Fibonacci numbers from a table of earlier ones',
  ['def', 'fibonacci', 'dp', 'return'], 'medium'),
 ('OOP', 'Build a calculator type for the four basic operations',
  ['class', 'Calculator', 'add', 'subtract', 'multiply', 'divide'], 'easy'),
 ('OOP', 'Build a bank account type that tracks its balance',
  ['class', 'BankAccount', 'deposit', 'withdraw', 'balance'], 'medium'),
 ('OOP', 'Derive dogs and cats from a common animal type', ['class', 'Animal', 'Dog', 'Cat', 'inherit'],
  'medium'),
 ('Advanced', 'Build a decorator that reports how long a call takes', ['def', 'decorator', 'time', 'wrapper'],
  'hard'),
 ('Advanced', 'Build a context manager that opens and closes a file',
  ['class', '__enter__', '__exit__', 'with'], 'hard'),
 ('Advanced', 'Yield Fibonacci numbers one at a time', ['def', 'yield', 'fibonacci', 'generator'], 'medium'),
 ('Practical', 'Check with a pattern whether a text is a mail address',
  ['def', 'email', 'regex', 're', 'return'], 'medium'),
 ('Practical', 'Turn CSV text into a list of records', ['def', 'csv', 'parse', 'return'], 'medium'),
 ('Practical', 'Fetch a page with requests and pick out its content', ['import', 'requests', 'def', 'scrape'],
  'medium'),
 ('Error Handling', 'Divide two numbers without failing on zero',
  ['def', 'try', 'except', 'ZeroDivisionError'], 'easy')]

BLANKS = "".join(chr(point) for point in BLANK_POINTS)
BLANK_CLASS = "".join(f"\\x{{{point:x}}}" for point in BLANK_POINTS)


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def pick(number: str, values) -> str:
    """CASE over 0, 1, 2, ... with already quoted values."""
    arms = " ".join(f"WHEN {at} THEN {value}" for at, value in enumerate(values))
    return f"CASE {number} {arms} END"


def by_template(values) -> str:
    return pick("template", values)


def filled(text: str) -> str:
    return f"replace({text}, '@a@', CAST(o_custkey AS VARCHAR))"


WS = q(BLANKS)
T = len(TEMPLATES)

SUBMISSIONS = f"""
submissions AS (
  SELECT o_orderkey AS seq, o_orderkey % {T} AS template,
    {pick(f"(o_orderkey // 16) % {len(CATEGORIES)}", map(q, CATEGORIES))} AS category,
    {pick(f"(o_orderkey // 128) % {len(INSTRUCTIONS)}", map(q, INSTRUCTIONS))} AS instruction,
    {filled(pick(f"o_orderkey % {T}", [q(t.code) for t in TEMPLATES]))} AS code,
    replace(CAST(o_orderdate AS VARCHAR), ' ', 'T') AS ts, o_custkey
  FROM orders)"""

PARSED = SUBMISSIONS + f""",
parsed AS (
  SELECT *, {by_template([q(t.status) for t in TEMPLATES])} AS status,
    {by_template([q(t.error) for t in TEMPLATES])} AS error,
    {by_template([str(t.function) for t in TEMPLATES])} AS has_function,
    {by_template([str(t.cls) for t in TEMPLATES])} AS has_class,
    {by_template([str(t.imported) for t in TEMPLATES])} AS has_import,
    {by_template([str(t.names) for t in TEMPLATES])} AS n_names,
    {by_template([str(t.meaningful) for t in TEMPLATES])} AS n_meaningful
  FROM submissions)"""


def text_facts(source: str) -> str:
    """Facts of the text column ``code``; '.' stops at line feeds only."""
    return f"""
lined AS (
  SELECT *, string_split(code, chr(10)) AS lines, trim(code, {WS}) = '' AS blank,
    lower(code) AS lc, lower(instruction) AS li
  FROM {source}),
stripped AS (SELECT *, [l FOR l IN lines IF trim(l, {WS}) <> ''] AS nb FROM lined),
facts AS (
  SELECT *, len(nb) AS n_nonblank, len(lines) AS n_lines,
    len(list_distinct([length(l) - length(ltrim(l, {WS})) FOR l IN nb
                       IF length(l) - length(ltrim(l, {WS})) > 0])) AS n_indents,
    len([l FOR l IN lines IF length(l) > 79]) AS n_long,
    len([l FOR l IN nb IF starts_with(trim(l, {WS}), '#')]) > 0 AS commented,
    contains(code, '\"\"\"') OR contains(code, '''''''') AS docstring,
    contains(code, ':') AND contains(code, '->') AS hinted,
    regexp_matches(code, '\\[.*for.*in.*\\]') AS e_list,
    regexp_matches(code, '\\(.*for.*in.*\\)') AS e_gen,
    regexp_matches(code, 'enumerate\\(') AS e_enum,
    regexp_matches(code, 'zip\\(') AS e_zip,
    regexp_matches(code, '\\.join\\(') AS e_join,
    regexp_matches(code, 'set\\(') AS e_set,
    regexp_matches(code, 'for.*\\+.*str') AS i_concat,
    regexp_matches(code, 'for.*for.*') AS i_nested
  FROM stripped)"""


ASKED = {word: f"contains(li, {q(word)})" for word in CONCEPTS}
MET = {
    word: f"({ASKED[word]} AND (" + " OR ".join(f"contains(lc, {q(k)})" for k in shown) + "))"
    for word, shown in CONCEPTS.items()
}
N_ASKED = " + ".join(f"CAST({flag} AS INT)" for flag in ASKED.values())
N_MET = " + ".join(f"CAST({flag} AS INT)" for flag in MET.values())
GOOD_NAMES = "(status = 'ok' AND n_meaningful > n_names * 0.7e0)"


def scale(base: int, *terms: str) -> str:
    total = " + ".join([str(base), *terms])
    return f"CASE WHEN blank THEN 0e0 ELSE CAST(greatest(least({total}, 100), 0) AS DOUBLE) END"


def plus(flag: str, value: int) -> str:
    return f"CASE WHEN {flag} THEN {value} ELSE 0 END"


SYNTAX = scale(
    0,
    f"CASE status WHEN 'ok' THEN 80 + {plus('has_function', 10)} + {plus('has_class', 10)}"
    f" + {plus('has_import', 5)} WHEN 'syntax_error' THEN 20 ELSE 10 END",
)
FUNCTIONALITY = scale(50, "10 * n_met", plus("n_asked > 0 AND n_asked = n_met", 20))
STYLE = scale(
    60, plus("n_indents BETWEEN 1 AND 2", 10), plus(GOOD_NAMES, 10), plus("commented", 10),
    plus("n_long = 0", 5),
)
EFFICIENCY = scale(
    70, *[plus(flag, 5) for flag in ("e_list", "e_gen", "e_enum", "e_zip", "e_join", "e_set")],
    plus("i_concat", -10), plus("i_nested", -10),
)
DOCUMENTATION = scale(40, plus("docstring", 30), plus("commented", 20), plus("hinted", 10))
COMPLEXITY = "CASE WHEN n_nonblank < 10 THEN 'low' WHEN n_nonblank < 30 THEN 'medium' ELSE 'high' END"
GRADE = (
    "CASE WHEN total >= 90 THEN 'A+' WHEN total >= 85 THEN 'A' WHEN total >= 80 THEN 'A-'"
    " WHEN total >= 75 THEN 'B+' WHEN total >= 70 THEN 'B' WHEN total >= 65 THEN 'B-'"
    " WHEN total >= 60 THEN 'C+' WHEN total >= 55 THEN 'C' WHEN total >= 50 THEN 'C-'"
    " WHEN total >= 45 THEN 'D+' WHEN total >= 40 THEN 'D' ELSE 'F' END"
)

FACTS = PARSED + "," + text_facts("parsed") + f""",
counted AS (SELECT *, {N_ASKED} AS n_asked, {N_MET} AS n_met FROM facts)"""

SCORED = FACTS + f""",
scaled AS (
  SELECT *, {SYNTAX} AS syn, {FUNCTIONALITY} AS fun, {STYLE} AS sty, {EFFICIENCY} AS eff,
    {DOCUMENTATION} AS doc, {COMPLEXITY} AS complexity
  FROM counted),
totalled AS (
  SELECT *, syn * 0.25e0 + fun * 0.30e0 + sty * 0.20e0 + eff * 0.15e0 + doc * 0.10e0 AS total
  FROM scaled),
scored AS (SELECT *, {GRADE} AS grade FROM totalled)"""

PROSE = """
prose AS (
  SELECT doc_id, '' AS instruction, CASE doc_id % 6
    WHEN 1 THEN '# ' || text
    WHEN 2 THEN '\"\"\"' || text || '\"\"\"'
    WHEN 3 THEN replace(text, chr(10), chr(10) || '    ')
    WHEN 4 THEN 'note: text -> ' || text
    WHEN 5 THEN replace(replace(text, chr(10), chr(10) || '  '), '. ', '.' || chr(10) || '    # ')
    ELSE text END AS code
  FROM documents),""" + text_facts("prose")

PAIRS = """
turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
    lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (
  SELECT conv_id * (SELECT max(turn) + 1 FROM conversations) + turn AS row_id, text AS instruction,
    CASE WHEN prev_role = 'system' THEN prev_text ELSE '' END AS input, next_text AS output
  FROM turns WHERE role = 'user' AND next_role = 'assistant')"""

PROMPT = (
    f"'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) ||"
    f" CASE WHEN trim(input, {WS}) = '' THEN '' ELSE"
    f" '### Input:' || chr(10) || input || chr(10) || chr(10) END ||"
    f" '### Response:' || chr(10)"
)

CASE_TABLE = "cases AS (SELECT * FROM (VALUES " + ", ".join(
    f"({at}, {q(category)}, {q(task)}, CAST([{', '.join(map(q, words))}] AS VARCHAR[]), {q(difficulty)})"
    for at, (category, task, words, difficulty) in enumerate([*CASES, (FREE_CASE[1], FREE_CASE[2], FREE_CASE[4], FREE_CASE[5])])
) + ") AS t(case_id, case_category, task, words, difficulty))"


def by_outcome(at: int, quote) -> str:
    return pick(f"(seq // 16) % {len(OUTCOMES)}", [quote(row[at]) for row in OUTCOMES.values()])


RUNS = PARSED + ",\n" + CASE_TABLE + f""",
runs AS (
  SELECT seq AS result_id, (seq // 16) % {N_CASE_NUMBERS} AS case_id, code, status, error,
    CASE WHEN seq % 50 <> 49 THEN (seq % 100) / 8e0 END AS execution_time, {by_outcome(0, str)} AS success,
    {filled(by_outcome(1, q))} AS output, {filled(by_outcome(2, q))} AS err,
    CAST({by_outcome(3, lambda code: 'NULL' if code is None else str(code))} AS INT) AS exit_code,
    CASE WHEN (seq // 16) % 11 = 10 THEN {q(GENERATION_ERROR)} END AS generation_error
  FROM parsed)"""

KEYWORD = "len(words) = 0 OR len([w FOR w IN words IF contains(lower(code), lower(w))]) > 0"
QUALITY = f"""CASE WHEN trim(code, {WS}) = '' THEN 'poor'
  WHEN points >= 7 THEN 'excellent' WHEN points >= 5 THEN 'good' WHEN points >= 3 THEN 'fair' ELSE 'poor' END"""

JUDGED = RUNS + f""",
matched AS (
  SELECT *, {KEYWORD} AS matched,
    len([l FOR l IN string_split(code, chr(10)) IF trim(l, {WS}) <> '']) AS n
  FROM runs JOIN cases USING (case_id)),
pointed AS (
  SELECT *, {plus("contains(code, 'def ') OR contains(code, 'class ')", 2)}
    + CASE WHEN contains(code, '\"\"\"') OR contains(code, '''''''') THEN 2
           WHEN contains(code, '#') THEN 1 ELSE 0 END
    + {plus("contains(code, 'try:') OR contains(code, 'except:')", 1)}
    + {plus("n >= 5", 1)} + {plus("n >= 15", 1)} + {plus("matched", 2)} AS points
  FROM matched),
classed AS (
  SELECT *, {QUALITY} AS quality, coalesce(generation_error, CASE WHEN status = 'other_error' THEN error END) AS problem
  FROM pointed),
judged AS (
  SELECT result_id, case_category AS category, task, difficulty, execution_time,
    problem IS NULL AND status = 'ok' AS valid,
    problem IS NULL AND matched AS keyword,
    CASE WHEN problem IS NULL THEN quality ELSE 'poor' END AS quality,
    CASE WHEN problem IS NULL AND status = 'ok' THEN success ELSE FALSE END AS success,
    CASE WHEN problem IS NULL AND status = 'ok' THEN output ELSE '' END AS output,
    CASE WHEN problem IS NULL AND status = 'ok' THEN err ELSE '' END AS err,
    CAST(CASE WHEN problem IS NULL THEN length(code) ELSE 0 END AS INT) AS code_length,
    CASE WHEN problem IS NULL THEN '' ELSE 'Error: ' || problem END AS notes
  FROM classed)"""


def feedback(pairs: list[tuple[str, str]]) -> str:
    items = ", ".join(f"CASE WHEN NOT blank AND ({flag}) THEN {q(words)} END" for flag, words in pairs)
    return f"array_to_string([x FOR x IN [{items}] IF x IS NOT NULL], ' | ')"


POSITIVE = feedback([
    ("has_function", "Contains function definitions"),
    ("has_class", "Contains class definitions"),
    ("has_import", "Uses imports appropriately"),
    *[(flag, "Implements " + word) for word, flag in MET.items()],
    ("n_asked > 0 AND n_asked = n_met", "Addresses all key requirements"),
    ("n_indents BETWEEN 1 AND 2", "Consistent indentation"),
    (GOOD_NAMES, "Meaningful variable names"),
    ("commented", "Includes comments"),
    ("n_long = 0", "Follows line length guidelines"),
    ("e_list", "Uses list comprehension"),
    ("e_gen", "Uses generator"),
    ("e_enum", "Uses enumerate"),
    ("e_zip", "Uses zip"),
    ("e_join", "Uses join"),
    ("e_set", "Uses set operations"),
    ("docstring", "Includes docstrings"),
    ("commented", "Includes inline comments"),
    ("hinted", "Uses type hints"),
])
SUGGESTED = feedback([
    *[(f"{ASKED[word]} AND NOT {MET[word]}", "Consider implementing " + word) for word in MET],
    ("i_concat", "Consider using join() for string concatenation in loops"),
    ("i_nested", "Consider optimizing nested loops if possible"),
])
STYLE_ISSUES = feedback([
    ("n_indents > 2", "Inconsistent indentation"),
    (f"status = 'ok' AND NOT {GOOD_NAMES}", "Consider more descriptive variable names"),
    ("n_long > n_lines * 0.3e0", "Some lines are too long (>79 characters)"),
])
ERRORS = (
    "CASE WHEN blank THEN 'Empty code' WHEN status = 'ok' THEN ''"
    " WHEN status = 'syntax_error' THEN 'Syntax error: ' || error ELSE 'Parse error: ' || error END"
)

TOP = SCORED + ", top AS (SELECT * FROM scored ORDER BY total DESC, seq LIMIT 10)"
TREND = """
numbered AS (SELECT total, row_number() OVER (ORDER BY seq DESC) AS back FROM scored),
trend AS (
  SELECT CASE WHEN count(*) < 10 THEN 'insufficient_data'
    WHEN sum(total) FILTER (back <= 5) / 5 > sum(total) FILTER (back BETWEEN 6 AND 10) / 5 + 5 THEN 'improving'
    WHEN sum(total) FILTER (back <= 5) / 5 < sum(total) FILTER (back BETWEEN 6 AND 10) / 5 - 5 THEN 'declining'
    ELSE 'stable' END AS recent_trend
  FROM numbered WHERE back <= 10)"""
KNOWN = "category IN (" + ", ".join(q(name) for name in KNOWN_CATEGORIES) + ")"


def shown(value: str) -> str:
    return f"CAST(printf('%.1f', round({value}, 9)) AS DOUBLE)"


def title(value: str) -> str:
    return f"array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(replace({value}, '_', ' '), ' ')], ' ')"


def names(kind: str, keep=None) -> str:
    """The sorted names of one kind per template, joined by commas."""
    chosen = [
        sorted(n for n in getattr(t, kind) if keep is None or n in keep) for t in TEMPLATES
    ]
    return by_template([q(",".join(row)) for row in chosen])


def leaderboard(width: int, limit: int) -> str:
    return (
        f"WITH {TOP} SELECT CAST(row_number() OVER (ORDER BY total DESC, seq) AS INT) AS position, grade,"
        f" {shown('total')} AS score, {title('category')} AS category,"
        f" CASE WHEN length(instruction) > {width} THEN left(instruction, {width}) || '...'"
        " ELSE instruction END AS instruction,"
        f" left(ts, 10) AS date FROM top ORDER BY total DESC, seq LIMIT {limit}"
    )


def usage() -> str:
    values = ", ".join(
        f"({at}, {q(kind)}, {q(name)})"
        for at, t in enumerate(TEMPLATES)
        for kind, found in (("import", t.imports), ("call", t.calls), ("attribute", t.attributes))
        for name in found
    )
    return (
        f"WITH {SUBMISSIONS}, found AS (SELECT * FROM (VALUES {values}) AS t(template, kind, name))"
        " SELECT kind, name, count(*) AS n_rows FROM submissions JOIN found USING (template) GROUP BY ALL"
    )


def scan(violation: str) -> str:
    text = by_template([q(getattr(t, violation)) for t in TEMPLATES])
    return (
        f"WITH {PARSED} SELECT seq, {text} IS NULL AND status <> 'other_error' AS is_safe, {text} AS violation,"
        f" CASE WHEN status = 'other_error' THEN 'Sandbox error: ' || error"
        f" ELSE 'Security violation: ' || {text} END AS scan_error FROM parsed"
    )


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '[{BLANK_CLASS}]*[^{BLANK_CLASS}]+')"


SCORE_COLUMNS = (
    "syn AS syntax_score, fun AS functionality_score, sty AS style_score, eff AS efficiency_score,"
    " doc AS documentation_score, round(total, 6) AS total_score, grade"
)
OVERALL = (
    "count(*) AS total_submissions, round(avg(total), 6) AS average_score,"
    " round(max(total), 6) AS highest_score, round(min(total), 6) AS lowest_score"
)
CASE_STATS = (
    "count(*) AS total, count(*) FILTER (valid) AS syntax_valid, count(*) FILTER (keyword) AS keyword_match,"
    " count(*) FILTER (success) AS execution_success, round(avg(execution_time), 6) AS avg_time"
)
BY_CATEGORY = (
    f"SELECT category, count(*) AS n_rows, round(avg(total), 6) AS average,"
    f" round(max(total), 6) AS best FROM scored WHERE {KNOWN} GROUP BY category"
)


DETAILS = """SELECT result_id, category, task AS instruction, difficulty, valid AS syntax_valid,
              keyword AS contains_keywords, quality AS estimated_quality, execution_time,
              code_length, notes FROM judged"""
SUMMARY = """SELECT count(*) AS total_tests, count(*) FILTER (valid) AS syntax_valid,
              round(count(*) FILTER (valid) / count(*) * 100, 6) AS syntax_valid_rate,
              count(*) FILTER (keyword) AS keyword_match,
              round(count(*) FILTER (keyword) / count(*) * 100, 6) AS keyword_match_rate,
              count(*) FILTER (success) AS execution_success,
              round(count(*) FILTER (success) / count(*) * 100, 6) AS execution_success_rate,
              round(avg(execution_time), 6) AS avg_execution_time FROM judged"""


def kept(source: str = SCORED) -> str:
    """The scored rows that are not refused as blank."""
    return source + f", kept AS (SELECT * FROM scored WHERE trim(code, {WS}) <> '')"


def build() -> dict[str, str]:
    pairs, facts, scored, judged = (f"WITH {part} " for part in (PAIRS, FACTS, SCORED, JUDGED))
    submissions, parsed, prose = (f"WITH {part} " for part in (SUBMISSIONS, PARSED, PROSE))
    text = f"{PROMPT} || output"
    count = f"len({tokens('text')})"
    position = "list_position([" + ", ".join(map(q, KNOWN_CATEGORIES)) + "], category)"
    return {
        # Instruction rows
        "sft_format": pairs + f"SELECT row_id, {text} AS text FROM pairs",
        "sft_prompt": pairs + f"SELECT row_id, {PROMPT} AS prompt FROM pairs",
        "sft_sample": pairs + "SELECT row_id, instruction, input, output FROM pairs ORDER BY row_id LIMIT 10",
        "sft_max_samples": pairs + "SELECT row_id, instruction, input, output FROM pairs ORDER BY row_id LIMIT 150",
        "sft_sample_by_text_key": pairs + "SELECT row_id, instruction, input, output FROM pairs ORDER BY instruction, row_id LIMIT 150",
        "sft_preview": pairs + """, one AS (SELECT * FROM pairs ORDER BY row_id LIMIT 1)
            SELECT 'instruction' AS field, left(instruction, 100) AS preview FROM one
            UNION ALL SELECT 'input', left(input, 100) FROM one
            UNION ALL SELECT 'output', left(output, 100) FROM one""",
        "sft_count": pairs + "SELECT count(*) AS n_rows FROM pairs",
        "sft_length": pairs + f""", formatted AS (SELECT row_id, {text} AS text FROM pairs)
            SELECT row_id, CAST({count} AS INT) AS n_tokens, {count} > 40 AS over_limit,
              CASE WHEN {count} > 40 THEN array_to_string({tokens('text')}[1:40], '') ELSE text END AS capped_text
            FROM formatted""",
        "response_extract": pairs + f"SELECT row_id, trim(output, {WS}) AS response FROM pairs",
        "candidate_rows": pairs + """, listed AS (SELECT row_id, string_split(output, chr(10)) AS c FROM pairs)
            SELECT row_id, CAST(unnest(range(1, len(c) + 1)) AS INT) AS candidate_no, unnest(c) AS candidate FROM listed""",
        "candidate_merge": pairs + """, listed AS (SELECT row_id, string_split(output, chr(10)) AS c FROM pairs)
            SELECT row_id, CASE WHEN len(c) = 1 THEN c[1] ELSE chr(10) || chr(10) || repeat('=', 50) ||
              array_to_string(['Output ' || i || ':' || chr(10) || c[i] FOR i IN range(1, len(c) + 1)],
                              chr(10) || chr(10)) END AS merged FROM listed""",
        "reject_blank": submissions
        + f"""SELECT seq, CASE WHEN trim(instruction, {WS}) = '' THEN 'blank instruction' ELSE 'blank generated_code' END AS reason
              FROM submissions WHERE trim(instruction, {WS}) = '' OR trim(code, {WS}) = ''""",
        "default_category": submissions + "SELECT seq, category FROM submissions",
        # Code analysis
        "code_features": parsed
        + """SELECT seq, status AS parse_status, status = 'ok' AS syntax_valid, error AS parse_error,
             has_function, has_class, has_import FROM parsed""",
        "name_quality": parsed + "SELECT seq, n_names, n_meaningful FROM parsed",
        "code_inventory": submissions
        + f"""SELECT seq, {names('imports')} AS imports, {names('calls')} AS calls,
              {names('attributes')} AS attributes FROM submissions""",
        "security_scan": scan("violation"),
        "security_scan_networking": scan("violation_networking"),
        "security_scan_stored": scan("violation_networking"),
        "security_scan_allowed": scan("violation_allowed"),
        "blocked_imports": submissions
        + f"SELECT seq, {names('imports', BLOCKED_IMPORTS)} AS blocked FROM submissions",
        "blocked_calls": submissions
        + f"SELECT seq, {names('calls', BLOCKED_BUILTINS)} AS blocked FROM submissions",
        "blocked_attributes": submissions
        + f"SELECT seq, {names('attributes', BLOCKED_ATTRIBUTES)} AS blocked FROM submissions",
        "violation_counts": f"SELECT violation, count(*) AS n_rows FROM ({scan('violation')})"
        " WHERE violation IS NOT NULL GROUP BY violation",
        "usage_counts": usage(),
        # Scores
        "score_syntax": facts + f"SELECT seq, {SYNTAX} AS syntax_score FROM counted",
        "score_functionality": facts + f"SELECT seq, {FUNCTIONALITY} AS functionality_score FROM counted",
        "score_style": facts + f"SELECT seq, {STYLE} AS style_score FROM counted",
        "score_efficiency": facts + f"SELECT seq, {EFFICIENCY} AS efficiency_score FROM counted",
        "score_docs": facts + f"SELECT seq, {DOCUMENTATION} AS documentation_score FROM counted",
        "complexity": facts
        + f"SELECT seq, {COMPLEXITY} AS complexity_estimate, CAST(length(code) AS INT) AS code_length FROM counted",
        "score_total": scored + f"SELECT seq, {SCORE_COLUMNS} FROM scored",
        "score_row": scored
        + f"""SELECT seq, instruction, code AS generated_code, ts AS timestamp, {SCORE_COLUMNS}, category,
              complexity AS complexity_estimate, CAST(length(code) AS INT) AS code_length FROM scored WHERE NOT blank""",
        "feedback": scored
        + f"""SELECT seq, {ERRORS} AS syntax_errors, {STYLE_ISSUES} AS style_issues,
              {POSITIVE} AS positive_features, {SUGGESTED} AS suggestions FROM scored""",
        "prose_efficiency": prose + f"SELECT doc_id, {EFFICIENCY} AS efficiency_score FROM facts",
        "prose_docs": prose + f"SELECT doc_id, {DOCUMENTATION} AS documentation_score FROM facts",
        "prose_complexity": prose
        + f"SELECT doc_id, {COMPLEXITY} AS complexity_estimate, CAST(length(code) AS INT) AS code_length FROM facts",
        "prose_style_lines": prose
        + "SELECT doc_id, CAST(n_lines AS INT) AS n_lines, CAST(n_nonblank AS INT) AS n_nonblank,"
        " CAST(n_indents AS INT) AS n_indents, CAST(n_long AS INT) AS n_long, commented FROM facts",
        # Evaluation
        "keyword_match": judged + "SELECT result_id, matched AS contains_keywords FROM classed",
        "quality_class": judged + "SELECT result_id, quality AS estimated_quality FROM classed",
        "outcome_class": f"WITH {RUNS} SELECT result_id, "
        + pick(f"(result_id // 16) % {len(OUTCOMES)}", map(q, OUTCOMES))
        + f""" AS outcome, CASE WHEN (result_id // 16) % {len(OUTCOMES)} = {list(OUTCOMES).index('exception')}
              THEN 'ValueError' END AS exception_name FROM runs""",
        "eval_gate": judged
        + """SELECT result_id, valid AS syntax_valid, success AS execution_success,
              output AS execution_output, err AS execution_error, notes FROM judged""",
        "eval_detail": judged + DETAILS,
        "eval_bucketed": judged + DETAILS,
        "eval_unmatched": f"WITH {RUNS} SELECT result_id, case_id, 'unknown case' AS reason FROM runs"
        " WHERE case_id NOT IN (SELECT case_id FROM cases)",
        "eval_summary": judged + SUMMARY,
        "eval_categories": judged + f"SELECT category, {CASE_STATS} FROM judged GROUP BY category",
        "eval_rates": judged
        + """SELECT category, round(count(*) FILTER (valid) / count(*) * 100, 6) AS syntax_rate,
              round(count(*) FILTER (keyword) / count(*) * 100, 6) AS keyword_rate,
              round(avg(execution_time), 6) AS avg_time FROM judged GROUP BY category""",
        "eval_quality": judged
        + "SELECT quality AS estimated_quality, count(*) AS n_rows FROM judged GROUP BY quality",
        "eval_expectation": judged
        + """SELECT count(*) FILTER (success = (result_id % 2 = 0)) AS passed, count(*) AS total,
              count(*) FILTER (success = (result_id % 2 = 0)) = count(*) AS all_passed FROM judged""",
        # Statistics and boards
        "stats_overall": scored + f"SELECT {OVERALL} FROM scored",
        "grade_distribution": scored + "SELECT grade, count(*) AS n_rows FROM scored GROUP BY grade",
        "category_performance": scored + BY_CATEGORY,
        "stats_view": scored + f", {TREND} SELECT count(*) AS total_submissions, {shown('avg(total)')} AS average,"
        f" {shown('max(total)')} AS highest, any_value({title('recent_trend')}) AS trend FROM scored, trend",
        "category_view": scored
        + f"""SELECT {position} AS position, {title('category')} AS name, {shown('avg(total)')} AS average,
              count(*) AS n_rows FROM scored WHERE {KNOWN} GROUP BY category""",
        "high_scores": f"WITH {TOP} SELECT seq, category, grade, round(total, 6) AS total_score FROM top",
        "high_scores_category": f"WITH {TOP} SELECT seq, category, grade, round(total, 6) AS total_score"
        " FROM top WHERE category = 'functions' ORDER BY total DESC, seq LIMIT 5",
        "leaderboard_view": leaderboard(50, 10),
        "leaderboard_top5": leaderboard(60, 5),
        "trend": scored + f", {TREND} SELECT recent_trend FROM trend",
        "trend_history": scored
        + """, windows AS (SELECT seq, list(total) OVER (ORDER BY seq ROWS 9 PRECEDING) AS t FROM scored),
              means AS (SELECT seq, len(t) AS n, (t[1] + t[2] + t[3] + t[4] + t[5]) / 5e0 AS older,
                               (t[6] + t[7] + t[8] + t[9] + t[10]) / 5e0 AS recent FROM windows)
              SELECT seq, CASE WHEN n < 10 THEN 'insufficient_data' WHEN recent > older + 5 THEN 'improving'
                               WHEN recent < older - 5 THEN 'declining' ELSE 'stable' END AS recent_trend FROM means""",
        "high_score_entries": scored
        + """, places AS (SELECT s.seq, s.total, 1 + (SELECT count(*) FROM scored e WHERE e.seq < s.seq AND e.total >= s.total) AS place FROM scored s)
              SELECT seq, round(total, 6) AS total_score, CAST(place AS INT) AS position FROM places WHERE place <= 10""",
        "empty_report": "SELECT unnest(['overall', 'grades', 'categories', 'summary', 'quality', 'cases']) AS part, CAST(0 AS BIGINT) AS n_rows",
        # Stores
        "history_roundtrip": f"WITH {kept()} SELECT seq, grade, round(total, 6) AS total_score,"
        f" {STYLE_ISSUES} AS style_issues, ts AS timestamp FROM kept",
        "history_top": f"WITH {kept()} SELECT seq, code AS generated_code, grade FROM kept ORDER BY total DESC, seq LIMIT 10",
        "history_export": f"WITH {kept()} SELECT seq, category, grade, round(total, 6) AS total_score FROM kept",
        "report_roundtrip": judged + f"SELECT category, {CASE_STATS} FROM judged GROUP BY category",
        "history_mixed": f"WITH {kept()} SELECT seq, round(total, 6) AS total_score, grade FROM kept",
        "history_mixed_stats": f"WITH {kept()} SELECT {OVERALL} FROM kept",
        "history_retry": f"WITH {kept()} SELECT seq, round(total, 6) AS total_score, grade FROM kept",
        "history_interrupted": f"WITH {kept()} SELECT seq, round(total, 6) AS total_score, grade FROM kept",
        "history_compacted": f"WITH {kept()} SELECT {OVERALL} FROM kept",
        "history_corrected": f"WITH {kept()} SELECT seq, category, round(total, 6) AS total_score, grade FROM kept",
        "stream_corrected": f"WITH {kept()} SELECT category, count(*) AS n_rows, round(avg(total), 6) AS average,"
        f" round(max(total), 6) AS best FROM kept WHERE {KNOWN} GROUP BY category",
        "stream_late_files": f"WITH {kept()} SELECT seq, round(total, 6) AS total_score, grade FROM kept",
        "stream_trend": f"WITH {kept()}, {TREND.replace('scored', 'kept')} SELECT recent_trend FROM trend",
        "history_import_file": f"WITH {kept()} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, round(total, 6) AS total_score,"
        " grade, category, ts AS timestamp, CAST(length(code) AS INT) AS code_length FROM kept",
        "history_refused": submissions
        + f"SELECT seq, 'blank generated_code' AS reason FROM submissions WHERE trim(code, {WS}) = ''",
        "history_import": f"WITH {kept()} SELECT seq + 1000 AS seq, round(total, 6) AS total_score, 'F' AS grade,"
        " 'low' AS complexity_estimate, 'general' AS category, 0e0 AS style_score, CAST(0 AS INT) AS code_length FROM kept",
        "sft_malformed": pairs + """SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'malformed' ELSE 'read' END AS status FROM pairs""",
        "report_summary_stored": judged + SUMMARY,
        "report_quality_stored": judged
        + "SELECT quality AS estimated_quality, count(*) AS n_rows FROM judged GROUP BY quality",
        "report_details_stored": judged + DETAILS,
        "report_unmatched_stored": f"WITH {RUNS} SELECT result_id, case_id, 'unknown case' AS reason FROM runs"
        " WHERE case_id NOT IN (SELECT case_id FROM cases)",
        # Streams
        "stream_restart": f"WITH {kept()} SELECT seq, round(total, 6) AS total_score, grade FROM kept",
        "stream_scores": f"WITH {kept()} SELECT seq, round(total, 6) AS total_score, grade FROM kept",
        "stream_stats": f"WITH {kept()} SELECT category, count(*) AS n_rows, round(avg(total), 6) AS average,"
        f" round(max(total), 6) AS best FROM kept WHERE {KNOWN} GROUP BY category",
        "stream_overall": f"WITH {kept()} SELECT {OVERALL} FROM kept",
        "stream_grades": f"WITH {kept()} SELECT grade, count(*) AS n_rows FROM kept GROUP BY grade",
        "stream_top10": f"WITH {kept()} SELECT seq, category, grade, round(total, 6) AS total_score"
        " FROM kept ORDER BY total DESC, seq LIMIT 10",
    }
