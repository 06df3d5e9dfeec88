"""Line-first quality cleaning.

Every line is tried against punctuation, navigation and boilerplate rules and dropped if it
fails one. A document is rejected if it loses too much of its text, or by plain counts
over the whole text (few words, repeated word windows).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tapeforge.llm.common import map_rows, slices

SYMBOLS = "#*$%&|<>"  # fixed value of the counts
# Phrases, in four languages, that mark a line as boilerplate or as navigation.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
               "uses cookies", "accept cookies", "lorem ipsum", "enable javascript", "click here to",
               "subscribe to our newsletter", "powered by", "licensed under", "released under the",
               "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "cookies akzeptieren",
               "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "accepter les cookies",
               "todos los derechos reservados", "términos y condiciones", "política de privacidad", "aviso legal", "aceptar cookies")
NAVIGATION = re.compile(r"(?i)^\W*(?:home|menu|next|previous|back|search|log ?in|sign ?up|share|tweet|print|skip to content|"
                        r"read more|contact us|about us|sitemap|top|"
                        r"startseite|menü|weiter|zurück|suche|anmelden|registrieren|teilen|drucken|kontakt|impressum|"
                        r"accueil|suivant|précédent|rechercher|connexion|s'inscrire|partager|imprimer|contactez-nous|"
                        r"inicio|siguiente|anterior|buscar|iniciar sesión|registrarse|compartir|imprimir|contacto)\W*$")
SEPARATORS = re.compile(r"\s[|»›>·•]\s")
LINK = re.compile(r"(?:https?://|www\.)\S+")
WORD_CHARACTERS = re.compile(r"\w")


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; all but the two on repeated words are asked of lines of every length."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_line_symbols: float = 0.10   # symbols per character of a line
    max_line_marks: float = 0.40     # characters other than letters and digits among those that aren't blank
    max_separators: int = 3          # separators in a line before it counts as navigation
    max_line_links: float = 0.3      # share of a line's characters that belong to links
    stutter_words: int = 10          # words of a line from which one word may not be
    max_stutter: float = 0.5         # more than this share of them
    max_lost: float = 0.5            # share of the words that may go with failing lines


DEFAULT = Rules()


def split_words(text: str) -> list[bytes]:
    """What stands between ASCII white space, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes], k: int = 3) -> int:
    """Words that lie in a ``k``-word window which the text holds twice or more, the first one included."""
    if len(words) <= k:
        return 0
    windows = list(zip(*(words[i:] for i in range(k))))
    if len(seen := Counter(windows)) == len(windows):
        return 0
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + k - max(i, upto)
            upto = i + k
    return total


def failing_rule(line: str, seen: bool, rules: Rules) -> str | None:
    """The first rule that a line with words fails: duplicate, boilerplate, navigation, punctuation or stutter.

    But for the phrases the rules hold in any language: repeated lines, links and separators, the share of symbols
    and of all marks, and one word said over and over.
    """
    if seen:
        return "duplicate"
    low = line.lower()
    if any(p in low for p in BOILERPLATE):
        return "boilerplate"
    if NAVIGATION.match(line) or len(SEPARATORS.findall(line)) > rules.max_separators:
        return "navigation"
    if ("://" in line or "www." in line) and sum(map(len, LINK.findall(line))) > rules.max_line_links * len(line):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > rules.max_line_symbols * len(line):
        return "punctuation"
    words = line.split()
    filled = sum(map(len, words))
    if filled - len(WORD_CHARACTERS.findall(line)) > rules.max_line_marks * filled:
        return "punctuation"
    if len(words) >= rules.stutter_words and max(Counter(words).values()) > rules.max_stutter * len(words):
        return "stutter"
    return None


def judge(text: str | None, rules: Rules = DEFAULT) -> tuple[list, str, dict[str, int]]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost], cleaned text, words
    lost per rule)."""
    text = text or ""
    words = split_words(text)
    chars = sum(len(w.decode("utf-8", "surrogatepass")) for w in words) if not text.isascii() else sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    dup, seen, kept_lines, lost, by_rule = 0, set(), [], 0, Counter()
    for line in text.split("\n"):
        n = len(split_words(line))
        if not n:
            kept_lines.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if rule := failing_rule(line, again, rules):
            by_rule[rule] += n
            lost += n
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    kept = not failed and lost <= rules.max_lost * len(words)
    return ([len(words), chars, symbols, dup, repeat, failed, kept, lost / len(words) if words else 0.0],
            "\n".join(kept_lines), dict(by_rule))


COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, lost double")


def measure(docs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """doc_id and the counts and verdict for every row of ``docs``; ``lost`` is the share of words in failing lines.

    A null or empty text has no words and fails. Texts of any length are read whole; repeated rows each get a row;
    other columns are ignored.
    """

    def run(b: pa.RecordBatch) -> list[list]:
        rows = [judge(t, rules)[0] for t in b.column(1).to_pylist()]
        return [b.column(0), *([r[k] for r in rows] for k in range(8))]

    return map_rows(docs.select("doc_id", "text"), f"doc_id long, {COLUMNS}", run)


def clean(docs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The kept rows of ``docs`` with the failing lines taken out of ``text``; all columns are returned."""

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            judged = [judge(t, rules) for t in b.column(at).to_pylist()]
            b = b.set_column(at, b.schema.field(at), pa.array([j[1] for j in judged], b.schema.field(at).type))
            yield b.filter(pa.array([j[0][6] for j in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
