"""Code texts that hit the thresholds of the rules."""

from __future__ import annotations

import random

from workload.templates import TEMPLATES

EDGES = [
    "", " ", " \n　", "\x1c\x1d\t\n", "x", "x=1\n", "pass",
    "def f():\n    return 1", "async def f():\n    pass", "class A: pass", "from . import x",
    "from .os import x", "import os.path as p, sys", "import json, os",
    "def f(:\n", "x = = 1", "a\x00b", "if x:\n\ty = 1\n\tif y:\n\t\tz = 2\n\t\tif z:\n\t\t\tw = 3",
    "if x:\n  y = 1\n  if y:\n    z = 2", "  indented = 1",
    "# only a comment", "x = 1  # trailing", "\n\n   # indented comment\nx = 1", " # nbsp before comment",
    "x = '" + "a" * 73 + "'", "x = '" + "a" * 74 + "'", "x = '" + "a" * 75 + "'",
    "\n".join(["x = '" + "a" * 90 + "'"] * 3 + ["y = 1"] * 7),
    "\n".join(["x = '" + "a" * 90 + "'"] * 4 + ["y = 1"] * 6),
    "\n".join(f"line{n} = {n}" for n in range(9)), "\n".join(f"line{n} = {n}" for n in range(10)),
    "\n".join(f"line{n} = {n}" for n in range(29)), "\n".join(f"line{n} = {n}" for n in range(30)),
    "abc = abd = abe = abf = abg = abh = abi = a = b = c", "abc = abd = abe = abf = abg = abh = abi = abj = b = c",
    "_abc = 1", "[a for a in b]", "(a for a in b)", "[1,\nfor x in y]", "sum(x for x in y if x)",
    "for i in s:\n    t += str(i)", "for i in s: t = t + str(i)", "for a in b: # for", "reset(", "set()",
    "for x in enumerate(zip(a, b)): print(','.join(set(x)))", "[in for]", "] for in [", "[ for in\r ]",
    "[ for in\u0085 ]", "[ for\u2029 in ]", "'''doc'''", '"""doc"""', "def f(a: int) -> int: return a",
    "a -> b : c", "try:\n    pass\nexcept:\n    pass", "x = {}\ny = []\nz = x.__class__.__mro__",
    "print(eval('1'))", "f(eval)", "x.eval()", "eval(open('f').read())", "getattr(os, 'x').__dict__",
    "-" * 300 + "1", "x = " + "-" * 100_000 + "1", "a" + ".b" * 400, "f(" * 50 + ")" * 50, "ÀÉ = 'ß'\nprint(ÀÉ)", "x = '😀' * 80",
    "def f():\n    '''Sort and search a list.'''\n    for item in []:\n        return sorted(item)",
]

INSTRUCTIONS = [
    "", "Write a FUNCTION", "Classify a dictionary", "sort and search a file, then print and return the list",
    "loop until a condition holds", "calculate", "Create a class with a function to calculate and print a list",
]


def codes() -> list[str]:
    return EDGES + [t.code.replace("@a@", "7") for t in TEMPLATES] + noise(150)


def noise(n: int, seed: int = 7) -> list[str]:
    """Random mixes of the pieces the rules look for."""
    pick = random.Random(seed)
    pieces = ["for", "in", "[", "]", "(", ")", "+", "str", "\n", "\r", " ", "    ", "#", "x", "name", "=",
              ":", "->", '"""', "\u2028", "\u00a0", "def ", "class ", "set(", "zip(", ".join(", "for", "\n"]
    return ["".join(pick.choice(pieces) for _ in range(pick.randint(1, 40))) for _ in range(n)]
