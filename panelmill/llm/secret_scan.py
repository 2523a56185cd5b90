"""Secrets by fixed patterns, and by what it would cost to guess the values in credential contexts.

The cost of a value is the least sum, over all ways to cut it into segments, of the segments' guesses (as powers of
ten): known words by rank, dates, repeats, keyboard walks, and brute force over the characters' alphabets for the
rest. A value that is cheap to guess is taken for a placeholder or a plain word, a dear one for a secret. What names a
value and is none (a variable, a call, a name of known words) is left out first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.bpe import read_ranks
from panelmill.llm.spans import apart_from

KINDS = ("assign", "access", "hex", "cred")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that announce a value; the value ends at a blank, quote, comma, semicolon or bracket.
CONTEXT = re.compile(
    r"(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?)"
    r"[\"']?\x20*[:=]{1,2}>?\x20*[\"']?([^\s\"',;<>(){}\[\]]{6,})", re.IGNORECASE | re.ASCII)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential")
#: Fixed: frequent passwords and words in credential contexts, most frequent first; the place is the number of guesses.
COMMON = """
password 123456 qwerty admin letmein welcome changeme secret test example dragon monkey login master hello
shadow football baseball sunshine princess iloveyou trustno1 superman batman access root user guest default public
private server database token key pass passwd apikey demo sample dummy none null true false undefined required
optional your here value string enter insert replace placeholder company internal external production staging
development local localhost service account manager system config settings summer winter spring autumn love
secure security temp temporary backup office super power computer internet google apple orange purple yellow
passwort kennwort geheim contrasena clave motdepasse senha wachtwoord parola haslo heslo
""".split()
#: A variable of a shell, template, batch file or statement.
VARIABLE = re.compile(r"\$+([A-Za-z_]\w*)|%([A-Za-z_]\w*)%|@([A-Za-z_]\w*)@|:([A-Za-z_]\w*)", re.ASCII)
#: An expression of code: names joined by dots, arrows or colons; in quotes or settings also by hyphens.
EXPRESSION = re.compile(r"[A-Za-z_]\w*(?:(?:\??\.|->|::)[A-Za-z_]\w*)*", re.ASCII)
NAME = re.compile(r"[A-Za-z_]\w*(?:(?:\??\.|->|::|-|/)[A-Za-z_]\w*)*", re.ASCII)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", re.ASCII)
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.ASCII)
LEET = str.maketrans("4310$57@!", "aeiossta" + "i")
NEXT_SEGMENT = 0.3
#: More than any one word of the list costs, with a capital; six random digits cost 6.
LEAST = 5.0
#: A name of known words that costs this much is taken for a passphrase.
PHRASE = 15.0


def _neighbours() -> dict[str, str]:
    """Keys beside each key: left and right in its row, and the two nearest in the rows above and below."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for i, key in enumerate(row):
            around = [(r, i - 1), (r, i + 1), (r - 1, i), (r - 1, i + 1), (r + 1, i - 1), (r + 1, i)]
            near[key] = {KEY_ROWS[a][b] for a, b in around if 0 <= a < len(KEY_ROWS) and 0 <= b < len(KEY_ROWS[a])}
    return {k: "".join(sorted(v)) for k, v in near.items()}


NEIGHBOURS = _neighbours()


@lru_cache(maxsize=1)
def language() -> dict[str, int]:
    """Rank of each word: COMMON, then the ASCII words of three letters or more of the 50k byte vocabulary, whose order is
    that of its merges (frequent ones first). Words of other languages are known only where English text has them."""
    import public_tokenizers
    tokens = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = (t[1:].decode().lower() for t in tokens if t[:1] == b" " and len(t) >= 4 and t[1:].isalpha())
    return {word: i + 1 for i, word in enumerate(dict.fromkeys((*COMMON, *own)))}


def by_alphabet(value: str) -> list[float]:
    """Brute force for each character: 10 digits, 26 letters (52 if the value has both cases), 33 signs, 100 beyond ASCII."""
    letter = log10(52 if value.lower() != value != value.upper() else 26)
    return [2.0 if c > "\x7f" else letter if c.isalpha() else 1.0 if c.isdigit() else log10(33) for c in value]


def segments(value: str, words: dict[str, int], longest: int, charges: Sequence[float]) -> Iterator[tuple[int, int, float, str]]:
    """(start, end, log10 of guesses, what) of all patterns in the value. Runs are given whole and in their prefixes' stead."""
    low, plain = value.lower(), value.lower().translate(LEET)
    if len(low) != len(value):
        low, plain = value, value.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = words.get(low[i:j]) or (words.get(plain[i:j]) and 10 * words[plain[i:j]])
            if rank:
                yield i, j, log10(rank + 1) + (0.3 if value[i:j] != low[i:j] else 0), "word"
    for i in range(n):
        if m := DATE.match(value, i):
            yield i, m.end(), log10(200 * (365 if m.end() - i > 6 else 12 if m.end() - i > 4 else 1)), "date"
    i = 0
    while i < n:
        j = i + 1
        while j < n and value[j] == value[i]:
            j += 1
        if j - i >= 3:
            yield i, j, log10(30 * (j - i)), "repeat"
        i = j
    for unit in range(2, 9):
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            times = (j - i) // unit
            if times >= 2:
                yield i, i + times * unit, sum(charges[i:i + unit]) + log10(times), "repeat"
                i += (times - 1) * unit
            i += 1
    for step in (NEIGHBOURS.get, lambda c: chr(ord(c) + 1) + chr(max(0, ord(c) - 1))):
        i = 0
        while i < n:
            j = i + 1
            while j < n and low[j] in (step(low[j - 1]) or ""):
                j += 1
            if j - i >= 3:
                yield i, j, log10(50) + 0.15 * (j - i), "walk"
            i = max(j - 1, i + 1)


def guess_cost(value: str, words: dict[str, int]) -> tuple[float, list[tuple[int, int, str]]]:
    """(log10 of the guesses, the cheapest segmentation), with ``by_alphabet`` for the characters of no pattern.

    Linear in the value's length: brute force goes on character by character, and patterns are bounded or whole runs.
    """
    charges = by_alphabet(value)
    ending: dict[int, list[tuple[int, float, str]]] = {}
    for i, j, cost, what in segments(value, words, max(map(len, words), default=0), charges):
        ending.setdefault(j, []).append((i, cost, what))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    brute: list[tuple[float, int]] = [(float("inf"), 0)]
    for j in range(1, len(value) + 1):
        fresh = best[j - 1][0] + (NEXT_SEGMENT if j > 1 else 0)
        cost, since = min((brute[j - 1][0], brute[j - 1][1]), (fresh, j - 1))
        brute.append((cost + charges[j - 1], since))
        ways = [(brute[j][0], since, "brute")]
        ways += [(best[i][0] + c + (NEXT_SEGMENT if i else 0), i, what) for i, c, what in ending.get(j, ())]
        best.append(min(ways))
    cuts, j = [], len(value)
    while j:
        _, i, what = best[j]
        cuts.append((i, j, what))
        j = i
    return best[-1][0], cuts[::-1]


def is_reference(value: str, quoted: bool, after: str, words: dict[str, int]) -> bool:
    """Whether the value names another one: a variable, a call or index (``after`` is the next character), or a name of
    several words, as ``my_secret_key`` and ``request.form`` are. Names are of known words, with single digits at most."""
    if not quoted and after in ("(", "[") and EXPRESSION.fullmatch(value):
        return True
    variable = VARIABLE.fullmatch(value)
    if not variable and not NAME.fullmatch(value):
        return False
    parts = PART.findall(variable[variable.lastindex] if variable else value)
    spelled = [p.lower() for p in parts if not p.isdigit()]
    known = all(len(p) <= 2 or p in words for p in spelled) and all(len(p) == 1 for p in parts if p.isdigit())
    return known and any(len(p) > 2 for p in spelled) and len(spelled) > (0 if variable else 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed."""
    low, found = text.lower(), []
    if any(word in low for word in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Sequence) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def costly_values(text: str, words: dict[str, int], least: float) -> list[tuple[int, int, str, float]]:
    """(start, end, "cred", cost) of the values in credential contexts that cost at least 10**least guesses, without references."""
    low = text.lower()
    if not any(hint in low for hint in HINTS) or not (":" in text or "=" in text):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        cost, value = guess_cost(m[1], words)[0], m[1]
        named = cost < PHRASE and is_reference(value, text[m.start(1) - 1] in "\"'", text[m.end(1):m.end(1) + 1], words)
        if cost >= least and not named:
            found.append((m.start(1), m.end(1), "cred", cost))
    return found


def scan(docs: DataFrame, least: float = LEAST, common: Sequence[str] | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind, cost; code points, end exclusive) of every whole text.

    ``spans`` has the base spans (cost null) and the costly values that overlap none of them, by start, then kind.
    ``common`` are words, most frequent first, in place of ``language()``; they go to every task. A null or empty text has none. Rows keep their number and doc_id, null or repeated; other columns are ignored.
    """
    words = language() if common is None else {word: i + 1 for i, word in enumerate(common)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "kind", "cost")
        shape = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.float64())))))
        for batch in batches:
            base, every = [], []
            for text in batch.column("text").fill_null("").to_pylist():
                own = base_spans(text)
                more = apart_from(costly_values(text, words, least), own)
                base.append([dict(zip(names, (*s, None))) for s in own])
                every.append([dict(zip(names, (*s, None)[:4])) for s in sorted(own + more, key=_order)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, shape), pa.array(every, shape)], ["doc_id", "base", "spans"])
    kind = "array<struct<start:long,end:long,kind:string,cost:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")
