"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard
parser evaluates the and/or/with expressions that follow the tags."""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm.base import per_text

# Notice phrases as words, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "cc by sa": "cc-by-sa",
    "all rights reserved": "all-rights-reserved",
    "dedicated to the public domain": "public-domain",
}
# Identifiers whose labels are not the identifier itself, and those that permit any use.
LABEL_OF = {"apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-3.0": "cc-by-nc", "gpl-2.0-only": "gpl-2", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3"}
PERMISSIVE = {"mit", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "public-domain"}
# Further identifiers, lower-cased, that expressions may name.
KNOWN = set(
    "0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 artistic-2.0 bsl-1.0 bsd-3-clause-clear bsd-4-clause cc-by-3.0 cc-by-4.0 "
    "cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 "
    "gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-or-later gpl-2.0+ gpl-3.0 gpl-3.0+ hpnd lgpl-2.0-only lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 "
    "lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c ms-pl ms-rl mit-0 mpl-1.1 mpl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 "
    "ruby upl-1.0 vim w3c wtfpl x11 zpl-2.1".split()
) | PERMISSIVE | LABEL_OF.keys() | {*NOTICES.values(), *BASE.values()}
CUSTOM = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
EXCEPTION = re.compile(r"[a-z0-9.-]*exception(?:-[0-9.]+)?")
TAG_WORDS = "spdx license identifier"
AFTER_TAG = re.compile(rb"[\t ]*:[\t ]*([^\n\r]*)")
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}
#: Maps every byte outside words to a space and A-Z to a-z.
FOLD = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c for c in range(256))


def parse(expression: str) -> tuple[set[str], bool] | None:
    """(labels, whether a choice among them permits any use) of a licence expression; None if malformed.

    with binds tightest, then and, then or. The exception that follows with is no label of its own:
    it becomes part of its license's, and leaves what that permits. Identifiers are those of KNOWN and custom
    references, exceptions have that word in their names; before anything else the expression has ended.
    """
    output: list[str] = []
    waiting: list[str] = []
    operand_next = True
    tokens = [t.rstrip(".:-") for t in TOKEN.findall(expression)]

    def named(k: int) -> bool:
        while k < len(tokens) and tokens[k] == "(":
            k += 1
        return k == len(tokens) or tokens[k] in KNOWN or bool(CUSTOM.fullmatch(tokens[k]))

    for k, token in enumerate(tokens):
        if token in RANK and not operand_next and not (EXCEPTION.fullmatch(" ".join(tokens[k + 1 : k + 2])) or k + 1 == len(tokens) if token == "with" else named(k + 1)):
            break  # prose follows
        if token == "(":
            if not operand_next:
                break
            waiting.append(token)
        elif token == ")":
            if operand_next or "(" not in waiting:
                return None
            while (top := waiting.pop()) != "(":
                output.append(top)
        elif token in RANK:
            if operand_next:
                return None
            while waiting and RANK.get(waiting[-1], 0) >= RANK[token]:
                output.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif operand_next:
            if not (named(k) or waiting[-1:] == ["with"]):
                return None
            output.append(token)
            operand_next = False
        else:
            break  # other words follow the expression on its line
    if operand_next or "(" in waiting:
        return None
    values: list[tuple[set[str], bool]] = []
    for token in output + waiting[::-1]:
        if token not in RANK:
            label = LABEL_OF.get(token, token)
            values.append(({label}, label in PERMISSIVE))
            continue
        right, left = values.pop(), values.pop()
        if token == "with":
            values.append(({f"{x} with {y}" for x in left[0] for y in right[0]}, left[1]))
        else:
            values.append((left[0] | right[0], left[1] and right[1] if token == "and" else left[1] or right[1]))
    return values[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for words, label in [*NOTICES.items(), *BASE.items(), (TAG_WORDS, None)]:
        found.add_word(f" {words} ", (label, words in BASE, len(words) + 2))
    found.make_automaton()
    return found


def expressions(text: bytes, tags: list[int]) -> list[str]:
    """What follows the tags, which begin at these words: after a colon, up to the line's end."""
    ends = [m.end() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    found = (AFTER_TAG.match(text, ends[w + TAG_WORDS.count(" ")]) for w in tags)
    return [m[1].lower().decode("utf-8", "replace") for m in found if m]


def scan(text: bytes, phrases: ahocorasick.Automaton) -> tuple:
    words = text.translate(FOLD).split()
    line = b" " + b" ".join(words) + b" "
    base, labels, starts, tags, hits = set(), set(), [], [], 0
    for end, (label, is_base, length) in phrases.iter(line.decode("latin-1")):
        if label is None:
            tags.append(end + 1 - length)
            continue
        labels.add(label)
        hits += 1
        if is_base:
            base.add(label)
            starts.append(end + 1 - length)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if starts or tags else None
    starts = np.searchsorted(spaces, starts).tolist() if starts else starts
    verdicts = [v for v in map(parse, expressions(text, np.searchsorted(spaces, tags).tolist())) if v] if tags else []
    for found, _ in verdicts:
        labels |= found
    permitted = all(v for _, v in verdicts) if verdicts else None
    score = 1 - 0.5 ** min(50, hits + 2 * len(verdicts))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, len(verdicts), permitted


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("n_tags", T.LongType()), T.StructField("permitted", T.BooleanType()),
])


def license_scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns and what every whole text says of its license.

    n_base counts all places of the base phrases, first_word and last_word are where the first and last
    of them start (words from 0; null without any). labels also has those of further notices and of
    well-formed tags (the words that the automaton finds, then a colon); malformed expressions and unknown
    identifiers give none. score is 1 - 2^-(notices + 2 tags). permitted
    says whether every tag leaves a choice that permits any use; null without a tag. A null text counts
    as empty: no words, no labels, score 0. Ties and repeated rows each give their own row, very long texts are
    read whole in linear time, an empty table gives no rows, and a column of keep named like an added one gives way to it. KNOWN, the
    identifiers that expressions may hold, are about 75 common ones, not all that exist.
    """

    def make() -> Callable[[list[bytes]], dict]:
        phrases = automaton()

        def work(texts: list[bytes]) -> dict:
            rows = [scan(x, phrases) for x in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(FIELDS)}

        return work

    return per_text(docs, keep, text, make, FIELDS)
