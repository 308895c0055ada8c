"""Fixed vocabularies of the scoring, evaluation and scanning rules.

Everything in this module is a fixed value: results are only right if these
words, patterns, weights, limits and messages stay exactly as written.
"""

from __future__ import annotations

# Submission categories and their titles, in display order.
CATEGORIES = {
    "functions": "Basic Functions",
    "classes": "Object-Oriented Programming",
    "algorithms": "Algorithms & Data Structures",
    "web": "Web Development",
    "data": "Data Processing",
    "advanced": "Advanced Python Features",
    "general": "General Programming",
}
DEFAULT_CATEGORY = "general"

# Concept asked for by an instruction -> text that shows it in code.
CONCEPTS = {
    "function": ["def ", "function"],
    "class": ["class ", "object"],
    "loop": ["for ", "while ", "loop"],
    "condition": ["if ", "elif ", "else:", "condition"],
    "list": ["list", "array", "[]"],
    "dict": ["dict", "dictionary", "{}"],
    "file": ["file", "open(", "read", "write"],
    "sort": ["sort", "sorted"],
    "search": ["search", "find", "index"],
    "calculate": ["calculate", "compute", "+", "-", "*", "/"],
    "return": ["return"],
    "print": ["print("],
}

# Weights of the five scores, added in this order.
WEIGHTS = {
    "syntax_score": 0.25,
    "functionality_score": 0.30,
    "style_score": 0.20,
    "efficiency_score": 0.15,
    "documentation_score": 0.10,
}

# Lowest total of each grade, best first; below the last one is F.
GRADES = {
    "A+": 90, "A": 85, "A-": 80,
    "B+": 75, "B": 70, "B-": 65,
    "C+": 60, "C": 55, "C-": 50,
    "D+": 45, "D": 40,
}
LOWEST_GRADE = "F"

# Non-blank line counts from which code is medium and high.
COMPLEXITY_MEDIUM = 10
COMPLEXITY_HIGH = 30

# Longest line within guidelines, share of long lines that is an
# issue, share of meaningful names to exceed, most indentation widths allowed.
LINE_WIDTH = 79
LONG_LINE_SHARE = 0.3
MEANINGFUL_SHARE = 0.7
INDENT_WIDTHS = 2

# Feedback texts.
EMPTY_CODE = "Empty code"
SYNTAX_ERROR = "Syntax error: "
PARSE_ERROR = "Parse error: "
HAS_FUNCTIONS = "Contains function definitions"
HAS_CLASSES = "Contains class definitions"
HAS_IMPORTS = "Uses imports appropriately"
IMPLEMENTS = "Implements "
CONSIDER_CONCEPT = "Consider implementing "
ALL_MET = "Addresses all key requirements"
INDENT_OK = "Consistent indentation"
INDENT_ISSUE = "Inconsistent indentation"
NAMES_OK = "Meaningful variable names"
NAMES_ISSUE = "Consider more descriptive variable names"
COMMENTS_OK = "Includes comments"
WIDTH_OK = "Follows line length guidelines"
WIDTH_ISSUE = "Some lines are too long (>79 characters)"
DOCSTRINGS_OK = "Includes docstrings"
INLINE_COMMENTS_OK = "Includes inline comments"
TYPE_HINTS_OK = "Uses type hints"

# Words that must follow each other within one line, per pattern.
# Each pattern is given by its pieces of literal text, in order.
EFFICIENT = {
    "Uses list comprehension": ("[", "for", "in", "]"),
    "Uses generator": ("(", "for", "in", ")"),
    "Uses enumerate": ("enumerate(",),
    "Uses zip": ("zip(",),
    "Uses join": (".join(",),
    "Uses set operations": ("set(",),
}
INEFFICIENT = {
    "Consider using join() for string concatenation in loops": ("for", "+", "str"),
    "Consider optimizing nested loops if possible": ("for", "for"),
}

# Quality classes and the points they need, best first.
QUALITY = {"excellent": 7, "good": 5, "fair": 3}
LOWEST_QUALITY = "poor"

# Scan policy.
BLOCKED_IMPORTS = (
    "os", "subprocess", "sys", "shutil", "glob", "socket", "urllib",
    "requests", "http", "ftplib", "smtplib", "telnetlib", "webbrowser",
    "ctypes", "multiprocessing", "threading", "asyncio", "concurrent",
    "importlib", "__import__", "eval", "exec", "compile", "open",
    "file", "input", "raw_input",
)
BLOCKED_BUILTINS = (
    "eval", "exec", "compile", "__import__", "open", "file", "input",
    "raw_input", "reload", "vars", "locals", "globals", "dir",
    "getattr", "setattr", "delattr", "hasattr",
)
BLOCKED_ATTRIBUTES = (
    "__class__", "__bases__", "__subclasses__", "__mro__", "__globals__",
    "__code__", "__func__", "__self__", "__module__", "__dict__",
)
ALLOWED_IMPORTS = (
    "math", "random", "datetime", "time", "json", "csv", "re",
    "collections", "itertools", "functools", "operator", "string",
    "decimal", "fractions", "statistics", "hashlib", "base64",
    "uuid", "copy", "pickle", "struct", "array", "heapq", "bisect",
)
NETWORK_IMPORTS = ("requests", "urllib", "http")
BLOCKED_IMPORT_TEXT = "Blocked import: "
BLOCKED_BUILTIN_TEXT = "Blocked builtin function: "
BLOCKED_ATTRIBUTE_TEXT = "Blocked attribute access: "

# How an execution outcome's error text begins.
TIMEOUT_PREFIX = "Code execution timed out after "
SECURITY_PREFIX = "Security violation: "
SANDBOX_PREFIX = "Sandbox error: "
SUBPROCESS_PREFIX = "Subprocess execution error: "

# Prompt headings and the text around merged candidates.
INSTRUCTION_HEADING = "### Instruction:\n"
INPUT_HEADING = "### Input:\n"
RESPONSE_HEADING = "### Response:\n"
SECTION_GAP = "\n\n"
CANDIDATE_RULE = "\n\n" + "=" * 50
FAILED_NOTE = "Error: "

# Recent-trend window, threshold and names.
TREND_ROWS = 5
TREND_STEP = 5.0
TREND_NAMES = ("insufficient_data", "improving", "declining", "stable")

# Fixed value: length of the high-score list.
TOP_SCORES = 10
