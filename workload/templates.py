"""Code texts and sentences the derived inputs are made of, with what is in them.

``@a@`` stands for a number that differs from row to row.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """A code text and what a parser finds in it."""

    code: str
    status: str = "ok"
    function: bool = False
    cls: bool = False
    imported: bool = False
    names: int = 0
    meaningful: int = 0
    imports: tuple[str, ...] = ()
    calls: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    violation: str | None = None
    violation_networking: str | None = None
    violation_allowed: str | None = None  # with os and urllib allowed
    error: str | None = None


TEMPLATES = [
    # 0: function with docstring and type hints
    Template(
        'def scale_@a@(value: int) -> int:\n'
        '    """Return the value times @a@."""\n'
        '    return value * @a@\n',
        function=True, names=3, meaningful=3,
    ),
    # 1: class with methods
    Template(
        "class Counter@a@:\n"
        "    def __init__(self):\n"
        "        self.total = @a@\n"
        "\n"
        "    def add(self, amount):\n"
        "        self.total += amount\n"
        "        return self.total\n",
        function=True, cls=True, names=4, meaningful=4, attributes=("total",),
    ),
    # 2: an import and an async function only
    Template(
        "import json\n\nasync def fetch_@a@(path):\n    return json.dumps(path)\n",
        imported=True, names=2, meaningful=2, imports=("json",), attributes=("dumps",),
    ),
    # 3: does not parse
    Template(
        "def broken_@a@(:\n    return @a@\n",
        status="syntax_error", error="invalid syntax (<unknown>, line 1)",
        violation="Syntax error: invalid syntax (<unknown>, line 1)",
        violation_networking="Syntax error: invalid syntax (<unknown>, line 1)",
        violation_allowed="Syntax error: invalid syntax (<unknown>, line 1)",
    ),
    # 4: empty
    Template(""),
    # 5: no-break spaces and line breaks only
    Template(
        "\u00a0\n\u00a0\n",
        status="syntax_error", error="invalid non-printable character U+00A0 (<unknown>, line 1)",
        violation="Syntax error: invalid non-printable character U+00A0 (<unknown>, line 1)",
        violation_networking="Syntax error: invalid non-printable character U+00A0 (<unknown>, line 1)",
        violation_allowed="Syntax error: invalid non-printable character U+00A0 (<unknown>, line 1)",
    ),
    # 6: nested comprehension in one line
    Template(
        "pairs = [(x, y) for x in range(@a@) for y in range(3)]\n",
        names=7, meaningful=3, calls=("range",),
    ),
    # 7: nested loops on separate lines
    Template(
        "total = 0\n"
        "for first in range(@a@):\n"
        "    for second in range(3):\n"
        "        total = total + first * second\n"
        "print(total)\n",
        names=11, meaningful=11, calls=("print", "range"),
    ),
    # 8: refused imports, one of them as a from-import of a submodule
    Template(
        "import math\n"
        "from urllib.parse import quote\n"
        "import os\n"
        "print(math.sqrt(@a@), os.getcwd(), quote('a b'))\n",
        imported=True, names=4, meaningful=3, imports=("math", "os", "urllib"),
        calls=("print", "quote"), attributes=("getcwd", "sqrt"),
        violation="Blocked import: urllib", violation_networking="Blocked import: os",
    ),
    # 9: a refused builtin, called as a method and then directly
    Template(
        "tool = Worker()\ntool.eval('1 + @a@')\nprint(eval('2 * @a@'))\n",
        names=5, meaningful=5, calls=("Worker", "eval", "print"), attributes=("eval",),
        violation="Blocked builtin function: eval",
        violation_networking="Blocked builtin function: eval",
        violation_allowed="Blocked builtin function: eval",
    ),
    # 10: chained refused attributes, the outer one is met first
    Template(
        "kind = @a@\nbase = kind.__class__.__mro__\nprint(base)\n",
        names=5, meaningful=5, calls=("print",), attributes=("__class__", "__mro__"),
        violation="Blocked attribute access: __mro__",
        violation_networking="Blocked attribute access: __mro__",
        violation_allowed="Blocked attribute access: __mro__",
    ),
    # 11: one long line among short ones
    Template(
        'message_@a@ = "this line is written to be longer than seventy-nine characters in total"\n'
        "first = 1\n"
        "second = 2\n"
        "third = first + second\n"
        "print(third)\n",
        names=8, meaningful=8, calls=("print",),
    ),
    # 12: more than thirty lines
    Template(
        "values = []\n" + "".join(f"values.append(@a@ + {n})\n" for n in range(32)),
        names=33, meaningful=33, attributes=("append",),
    ),
    # 13: three indentation widths
    Template(
        "def deep_@a@(flag):\n"
        "  if flag:\n"
        "     while flag:\n"
        "         flag = flag - 1\n"
        "  return flag\n",
        function=True, names=5, meaningful=5,
    ),
    # 14: short and private names, comments
    Template(
        "# short names\nx = @a@\ny = x + 1\n_hidden = y\n# done\nz = _hidden\n",
        names=7,
    ),
    # 15: other line breaks inside a bracket within a text, in one long line
    Template(
        'value_@a@ = """[one for\u2028two in\rthree] and some more words to make this line a long one"""',
        names=1, meaningful=1,
    ),
    # 16: the efficient calls
    Template(
        'words = ["one", "two"]\n'
        "for place, word in enumerate(words):\n"
        "    print(place, word)\n"
        "table = dict(zip(words, set(words)))\n"
        'print(",".join(words), table, @a@)\n',
        names=17, meaningful=17, calls=("dict", "enumerate", "print", "set", "zip"), attributes=("join",),
    ),
    # 17: a text built up in the line of its loop
    Template(
        'text = ""\nfor item in range(@a@): text = text + str(item)\n',
        names=7, meaningful=7, calls=("range", "str"),
    ),
    # 18: between ten and thirty lines
    Template(
        "first = @a@\n" + "".join(f"value{n} = first * {n}\n" for n in range(14)),
        names=29, meaningful=29,
    ),
    # 19: documented, guarded and long enough for the best quality
    Template(
        "def divide_@a@(upper, lower):\n"
        '    """Divide, and return None for a zero."""\n'
        "    result = None\n"
        "    try:\n"
        "        result = upper / lower\n"
        "    except:\n"
        "        result = None\n"
        "    if result is None:\n"
        "        return None\n"
        "    rounded = round(result)\n"
        "    if rounded > 10:\n"
        "        return 10\n"
        "    if rounded < 0:\n"
        "        return 0\n"
        "    return rounded\n",
        function=True, names=12, meaningful=12, calls=("round",),
    ),
    # 20: nearly everything that earns points
    Template(
        "import json\n"
        "# a ledger of amounts\n"
        "class Ledger@a@:\n"
        '    """Keep a list of amounts."""\n'
        "    def total(self, amounts: list) -> int:\n"
        '        """Calculate, sort, search and return; also print(...) it."""\n'
        "        known = [amount for amount in amounts if amount in set(amounts)]\n"
        "        for place, amount in enumerate(sorted(known)):\n"
        '            print(place + amount, ",".join(map(str, known)))\n'
        "        both = list(zip(known, amounts))\n"
        "        return sum(amount for amount in known) + known.index(both[0][0])\n",
        function=True, cls=True, imported=True, names=31, meaningful=31, imports=("json",),
        calls=("enumerate", "list", "map", "print", "set", "sorted", "sum", "zip"), attributes=("index", "join"),
    ),
    # 21: nested too deeply for the parser, which is no syntax error
    Template(
        "x = " + "-" * 6500 + "@a@\n",
        status="other_error", error="Parser stack overflowed - Python source too complex to parse",
    ),
    # 22: a dictionary, a file, something sorted and something searched
    Template(
        "records = {}\n"
        'records["found"] = sorted([@a@, 3])\n'
        'place = "haystack".find("n")\n'
        "handle = None\n"
        "if handle:\n"
        '    records["text"] = handle.read()\n'
        "print(records, place)\n",
        names=11, meaningful=11, calls=("print", "sorted"), attributes=("find", "read"),
    ),
    # 23: a comment only
    Template("# still to do: @a@\n"),
]

INSTRUCTIONS = [
    "Say hello politely",
    "Write a function that doubles a number",
    "Create a class for a counter and print its total",
    "Loop over a list and return the largest value",
    "Sort a list of names",
    "Search a file for a word",
    "Calculate the mean and print it",
    "Build a dictionary of word counts",
    "Classify inputs under a condition",
    "Return the smallest item",
    "Explain recursion briefly to someone who knows other languages",
    "Write a function to sort and search the records of a very large archive",
    "",
    "\u00a0 ",
]

CATEGORIES = ["functions", "classes", "algorithms", "web", "data", "advanced", "general", "mystery"]

# Outcome class -> success, output, error, exit code.
OUTCOMES = {
    "success": (True, "result @a@", "", None),
    "timeout": (False, "", "Code execution timed out after 10 seconds", None),
    "security_violation": (False, "", "Security violation: Blocked import: os", None),
    "sandbox_error": (False, "", "Sandbox error: out of memory", None),
    "subprocess_error": (False, "", "Subprocess execution error: no interpreter", None),
    "exception": (False, "part @a@", "ValueError: bad value @a@\nTraceback (most recent call last):", None),
    "nonzero_exit": (False, "", "Traceback (most recent call last):\nKeyError: @a@", 1),
    "unknown": (False, "", "it went wrong somehow", None),
}
GENERATION_ERROR = "model unavailable"

# One case more than the built-in ones: no keyword is asked for.
FREE_CASE = (19, "Basic Functions", "Write whatever you like", "", [], "easy", "Anything goes")
N_CASE_NUMBERS = 21  # runs also name a case that does not exist
