"""The rules once more in plain Python, to check the Spark columns against."""

from __future__ import annotations

import ast
import re

WEIGHTS = (0.25, 0.30, 0.20, 0.15, 0.10)
LADDER = [
    (90, "A+"), (85, "A"), (80, "A-"), (75, "B+"), (70, "B"), (65, "B-"),
    (60, "C+"), (55, "C"), (50, "C-"), (45, "D+"), (40, "D"),
]
# Fixed values.
SHOWN = {
    "function": ["def ", "function"], "class": ["class ", "object"],
    "loop": ["for ", "while ", "loop"], "condition": ["if ", "elif ", "else:", "condition"],
    "list": ["list", "array", "[]"], "dict": ["dict", "dictionary", "{}"],
    "file": ["file", "open(", "read", "write"], "sort": ["sort", "sorted"],
    "search": ["search", "find", "index"],
    "calculate": ["calculate", "compute", "+", "-", "*", "/"],
    "return": ["return"], "print": ["print("],
}
GOOD = [r"\[.*for.*in.*\]", r"\(.*for.*in.*\)", r"enumerate\(", r"zip\(", r"\.join\(", r"set\("]
BAD = [r"for.*\+.*str", r"for.*for.*"]


def parse(code: str):
    try:
        return "ok", list(ast.walk(ast.parse(code)))
    except SyntaxError:
        return "syntax_error", []
    except Exception:
        return "other_error", []


def scales(instruction: str, code: str) -> tuple[float, ...]:
    if not code.strip():
        return (0.0,) * 5
    status, nodes = parse(code)

    def has(*kinds) -> bool:
        return any(type(node) in kinds for node in nodes)

    if status == "ok":
        syntax = min(100, 80 + 10 * has(ast.FunctionDef) + 10 * has(ast.ClassDef)
                     + 5 * has(ast.Import, ast.ImportFrom))
    else:
        syntax = 20 if status == "syntax_error" else 10

    asked = [word for word in SHOWN if word in instruction.lower()]
    met = [word for word in asked if any(shown in code.lower() for shown in SHOWN[word])]
    functionality = min(100, 50 + 10 * len(met) + 20 * bool(asked and met == asked))

    lines = code.split("\n")
    indents = {len(line) - len(line.lstrip()) for line in lines if line.strip()} - {0}
    commented = any(line.lstrip().startswith("#") for line in lines)
    names = [node.id for node in nodes if isinstance(node, ast.Name)]
    clear = [name for name in names if len(name) > 2 and not name.startswith("_")]
    style = 60 + 10 * (1 <= len(indents) <= 2) + 10 * commented
    style += 10 * (status == "ok" and len(clear) > len(names) * 0.7)
    style += 5 * all(len(line) < 80 for line in lines)

    efficiency = 70 + sum(5 for p in GOOD if re.search(p, code)) - sum(10 for p in BAD if re.search(p, code))
    documentation = 40 + 30 * ('"""' in code or "'''" in code) + 20 * commented
    documentation += 10 * (":" in code and "->" in code)
    parts = syntax, functionality, style, max(0, min(100, efficiency)), min(100, documentation)
    return tuple(float(part) for part in parts)


def total(parts) -> float:
    result = parts[0] * WEIGHTS[0]
    for part, weight in zip(parts[1:], WEIGHTS[1:]):
        result += part * weight
    return result


def grade(value: float) -> str:
    return next((name for least, name in LADDER if value >= least), "F")


def complexity(code: str) -> str:
    n = sum(1 for line in code.split("\n") if line.strip())
    return "low" if n < 10 else "medium" if n < 30 else "high"


def quality(code: str, keywords) -> str:
    if not code.strip():
        return "poor"
    n = sum(1 for line in code.split("\n") if line.strip())
    points = 2 * ("def " in code or "class " in code)
    points += 2 if '"""' in code or "'''" in code else int("#" in code)
    points += ("try:" in code or "except:" in code) + (n >= 5) + (n >= 15)
    points += 2 * (not keywords or any(word.lower() in code.lower() for word in keywords))
    return "excellent" if points >= 7 else "good" if points >= 5 else "fair" if points >= 3 else "poor"


def first_refused(code: str, imports: set, calls: set, attributes: set) -> str | None:
    """By recursion over the tree, parents first."""

    def visit(node):
        if isinstance(node, ast.Import):
            for item in node.names:
                if item.name.split(".")[0] in imports:
                    return "Blocked import: " + item.name.split(".")[0]
        if isinstance(node, ast.ImportFrom) and node.module and node.module.split(".")[0] in imports:
            return "Blocked import: " + node.module.split(".")[0]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in calls:
            return "Blocked builtin function: " + node.func.id
        if isinstance(node, ast.Attribute) and node.attr in attributes:
            return "Blocked attribute access: " + node.attr
        for child in ast.iter_child_nodes(node):
            found = visit(child)
            if found:
                return found
        return None

    return visit(ast.parse(code))
