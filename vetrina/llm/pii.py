"""Operator 6, surrogates for personal data.

Detected entities are replaced by keyed surrogates of their own type and
shape: letters become letters of the same case and script, digits become
digits, separators stay, and each type keeps what makes it plausible (card
and IBAN check digits, private address ranges, top-level domains, country
codes, the gender a title or given name implies).

* **Coreference.** A surrogate depends only on the key and the entity's
  canonical form, so spellings of one entity (case, separators, with or
  without given name) get one surrogate throughout the corpus.
* **Distinctness.** The distinct entities of the whole corpus are grouped by
  surrogate; where two entities share one, or a surrogate is itself an
  entity of the corpus, all but the smallest entity draw again, until no
  collision is left.  Draws from attempt ``WIDER`` on come from larger
  spaces, so that this ends however full a format is: one more character
  each time, and for addresses any octets of the private range (else any
  public address), then 10.0.0.0/8 (else 240.0.0.0/4), and at last the
  private IPv6 range fd00::/8, which no IPv4 corpus fills.

Texts without any trigger pass straight through; only the others shuffle.

Types: email, ip, card, iban, ssn, phone, secret (long hexadecimal strings
and common key prefixes), and persons named after a title, with all their
names and initials, wherever the same text names them again without one;
titles and particles (van, de la) stay.

Defined cases: a null text stays null and an empty one empty, both with no
entities; overlapping matches are settled by the first, then the longest;
rows that share an id are rows of their own; an empty table gives an empty
result; of the input columns, ``n_entities`` and ``entities`` are replaced,
all others are returned as they were, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetrina.llm.common import by_bytes, each, materialize, text_key, whole_text

KEY = b"vetrina surrogate key"  # a default for tests; pass a secret one
RESULT = ("n_entities", "entities")
WIDER = 4  # attempts that keep an entity's format exactly

# Titles by gender, given names by script and gender.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Lord", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Señorita", "Lady", "Госпожа"),
          "n": ("Dr", "Prof", "Professor", "Доктор")}
GIVEN = {("latin", "m"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul"),
         ("latin", "f"): ("Ada", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ines", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
         ("latin", "n"): ("Alex", "Chris", "Dana", "Eli", "Jamie", "Kim", "Lee", "Mika", "Noor", "Robin", "Sam", "Toni"),
         ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Лев", "Павел"),
         ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Ольга"),
         ("cyrillic", "n"): ("Женя", "Саша", "Валя", "Слава")}
_GENDER = {n.casefold(): g for (_, g), names in GIVEN.items() for n in names if g != "n"}
_SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve".split(),
              "cyrillic": "ба бе ви га да де ка ке ла ле ми на не по ра ре са си та то".split()}
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

# A name: words, initials and lower-case particles, any number of them, with
# white space between (a blank line ends it); "'s" is no part of a word.
_UPPER = r"[^\W\d_a-zà-öø-ÿа-я]"
_MORE = r"(?:['’-](?!s(?!\w))[^\W\d_]+)"
_WORD = rf"(?:[dDlL]['’]|(?:al|el)-)?{_UPPER}(?:[^\W\d_]+{_MORE}*|{_MORE}+)"
_INITIALS = rf"{_UPPER}\.(?:-?{_UPPER}\.)*"
_GAP = r"(?:[^\S\n]++\n?+|\n)[^\S\n]*+"
_PARTICLE = r"(?:van|von|vom|vander|de|der|den|del|della|degli|di|da|das|dos|do|du|des|la|le|las|los|zu|zum|zur|ten|ter|te|af|av|y|bin|ibn|bint|al|el|фон|де|ван)(?!\w)"
_PART = rf"(?:{_INITIALS}|{_WORD}|{_UPPER}(?!\w)(?={_GAP}{_UPPER}))"
_NAME = rf"(?:{_PARTICLE}{_GAP})*{_PART}(?:(?:{_GAP}|(?<=\.))(?:{_PARTICLE}{_GAP})*{_PART})*"
_PARTS = re.compile(rf"{_WORD}|{_INITIALS}|{_UPPER}")
_MENTION = re.compile(rf"(?<!\w)[^\W\d_]+{_MORE}*(?!\w)")
_TITLE = "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True))
_TITLED = rf"(?:{_TITLE})(?!\w)"
_AFTER = rf"(?:\.(?:{_GAP})?|{_GAP})"
_PATTERNS = (
    ("email", r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|sk-[0-9A-Za-z_\-]{20,}|xox[abpr]-[0-9A-Za-z\-]{20,})(?![0-9A-Za-z])"),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"),
    ("phone", r"(?<!\w)\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,5}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-]|\.\d)"),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    ("card", r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-]|\.\d)"),
    ("person", rf"(?<!\w)(?P<title>{_TITLED}(?:{_AFTER}{_TITLED})*){_AFTER}(?P<name>{_NAME})"),
)
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _PATTERNS))
#: What every entity holds: a digit or @, or else (persons) the beginning of
#: a title.  Cheap to find in a text; what it lets through is examined whole.
TRIGGER = "[0-9@]"
_TITLES_BEGIN = ("Mr", "Ms", "Miss", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Lord", "Госпо", "Frau", "Madame", "Mme", "Lady", "Dr", "Prof", "Доктор")


# -- detection ----------------------------------------------------------

def _luhn(digits: str) -> int:
    """Remainder of the check sum: 0 where it is right."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _script(s: str) -> str:
    c = next((c for c in s if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities of a text, in
    order.  Names found after a title are found without one, too."""
    out, names = [], {}
    for m in _ANY.finditer(text):
        kind, (a, b) = next(k for k, _ in _PATTERNS if m[k] is not None), m.span()
        s = text[a:b]
        if kind == "email":
            b = a + len(s.rstrip(".-_"))
            out.append((a, b, kind, text[a:b].lower()))
        elif kind == "ip":
            if all(int(x) < 256 for x in s.split(".")):
                out.append((a, b, kind, s))
        elif kind == "iban":
            flat = s.replace(" ", "")
            if 15 <= len(flat) <= 34 and _iban_rest(flat) == 1:
                out.append((a, b, kind, flat))
        elif kind == "secret":
            if any(c.isdigit() for c in s):
                hexadecimal = re.fullmatch("[0-9A-Fa-f]+", s)
                out.append((a, b, kind, s.lower() if hexadecimal else s))
        elif kind == "person":
            titles = re.findall(_TITLED, m["title"])
            gender = next((g for t in titles for g, own in TITLES.items() if g != "n" and t in own), "n")
            parts = [(p.start() + m.start("name"), p.end() + m.start("name")) for p in _PARTS.finditer(m["name"])]
            words = [p for p in parts if sum(c.isalpha() for c in text[slice(*p)]) > 1 and text[p[1] - 1] != "."]
            if gender == "n":
                gender = next((_GENDER[w] for w in (text[slice(*p)].casefold() for p in words[:-1]) if w in _GENDER), "n")
            whole = set(words)
            for p in parts:
                s = text[slice(*p)]
                role = "initial" if p not in whole else "family" if p == words[-1] else f"given-{gender}"
                kind, value = f"{role}-{_script(s)}", s.casefold()
                out.append((*p, kind, value))
                if p in whole:
                    names.setdefault(value, kind)
        else:
            digits = "".join(c for c in s if c.isdigit())
            if kind != "phone" or 9 <= len(digits) <= 15:
                out.append((a, b, kind, ("+" if s[0] == "+" else "") + digits))
    return _untitled(text, out, names) if names else out


def _untitled(text: str, found: list[tuple], names: dict[str, str]) -> list[tuple]:
    """``found`` and the other mentions of ``names``, written with a capital;
    of a hyphenated word or a genitive also its pieces."""
    ends, starts, more = [f[1] for f in found], [f[0] for f in found], []
    for m in _MENTION.finditer(text):
        pieces = [m.span()] if m[0].casefold() in names else [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^\W_]+", m[0])]
        for a, b in pieces:
            value = text[a:b].casefold()
            if value in names and re.match(f"(?:[dl]['’]|(?:al|el)-)?{_UPPER}", text[a:b]) and bisect.bisect_right(ends, a) == bisect.bisect_left(starts, b):
                more.append((a, b, names[value], value))
    return sorted(found + more)


# -- surrogates ---------------------------------------------------------

class _Draws:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, *of):
        self._key, self._of, self._n, self._rest = key, "\x1f".join(map(str, of)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self._rest) < 4:
            self._rest = hmac.new(self._key, self._of + self._n.to_bytes(4, "big"), hashlib.sha256).digest()
            self._n += 1
        head, self._rest = self._rest[:4], self._rest[4:]
        return int.from_bytes(head, "big") % n

    def like(self, s: str) -> str:
        """Digits for digits, letters for letters of the script and case."""
        out = []
        for c in s:
            if c.isdigit():
                c = str(self.below(10))
            elif c.isalpha():
                letters = _LETTERS[_script(c)]
                new = letters[self.below(len(letters))]
                c = new.upper() if c.isupper() else new
            out.append(c)
        return "".join(out)


@functools.cache
def _initials(key: bytes, script: str) -> dict[str, str]:
    """A keyed permutation of an alphabet that leaves no letter in place."""
    order = sorted(_LETTERS[script], key=lambda c: hmac.digest(key, f"initial {c}".encode(), "sha256"))
    return dict(zip(order, order[1:] + order[:1], strict=True))


def _address(draw: _Draws, value: str, attempt: int) -> str:
    octets = value.split(".")
    private = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] or octets[0] == "172" and 16 <= int(octets[1]) < 32 else 0
    if attempt < WIDER:
        low, high = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 100, 3: 256}
        return ".".join(o if i < private else str(low[len(o)] + draw.below(high[len(o)] - low[len(o)])) for i, o in enumerate(octets))
    if attempt >= WIDER + 4:
        return "fd" + ":".join(f"{draw.below(1 << 16):04x}" for _ in range(8))[2:]
    if attempt >= WIDER + 2:
        head = ["10"] if private else [str(240 + draw.below(16))]
    elif private:
        head = [octets[0], *(["168"] if octets[0] == "192" else [str(16 + draw.below(16))] if private == 2 else [])]
    else:
        public = [n for n in range(1, 224) if n not in (10, 127, 172, 192)]
        head = [str(public[draw.below(len(public))])]
    return ".".join(head + [str(draw.below(256)) for _ in range(4 - len(head))])


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Canonical form of the replacement of an entity's canonical form."""
    draw = _Draws(key, kind, value, attempt)
    more = max(0, attempt - WIDER + 1)  # characters beyond the entity's own
    if kind == "email":
        local, _, host = value.rpartition("@")
        name, _, top = host.rpartition(".")
        return f"{draw.like(local + 'a' * more)}@{_Draws(key, 'host', name, attempt // 8).like(name)}.{top}"
    if kind == "ip":
        return _address(draw, value, attempt)
    if kind == "card":
        new = value[0] + draw.like(value[1:-1] + "0" * more)
        return new + str((-_luhn(new + "0") + (0 if _luhn(value) == 0 else 1 + draw.below(9))) % 10)
    if kind == "iban":
        body = value[:2] + "00" + draw.like(value[4:] + "0" * more)
        return f"{body[:2]}{98 - _iban_rest(body):02d}{body[4:]}"
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + draw.like("0" * more)
    if kind == "phone":
        keep = 2 if value[0] == "+" else 0  # the sign and the country code's first digit
        return value[:keep] + draw.like(value[keep:] + "0" * more)
    if kind == "secret":
        prefix = re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-|", value)[0]
        rest = value[len(prefix):] + "0" * more
        if re.fullmatch("[0-9a-f]+", rest):
            return prefix + "".join("0123456789abcdef"[draw.below(16)] for _ in rest)
        return prefix + draw.like(rest)
    role, *gender, script = kind.split("-")
    if role == "initial":
        return "".join(_initials(key, _script(c)).get(c) or draw.like(c) for c in value)
    syllables = _SYLLABLES.get(script)
    if syllables is None:
        return draw.like(value + value[-1] * more)
    if role == "given":
        names = GIVEN[script, gender[0]]
        more = "".join(syllables[draw.below(len(syllables))] for _ in range(attempt))
        return names[draw.below(len(names))].lower() + more
    return "".join(syllables[draw.below(len(syllables))] for _ in range(3 + attempt // 8 + draw.below(2)))


def dress(kind: str, canonical: str, as_in: str) -> str:
    """A canonical surrogate in the format of one mention."""
    if kind.startswith(("given", "family")):
        return canonical.upper() if as_in.isupper() and len(as_in) > 1 else canonical.capitalize() if as_in[0].isupper() else canonical
    if kind == "ip" or kind in ("email", "secret") and len(canonical) != len(as_in):
        return canonical.upper() if kind == "email" and as_in.isupper() else canonical
    out, rest = [], iter(c for c in canonical if c.isalnum())
    for c in as_in:
        if c.isalnum():
            new = next(rest)
            c = new.upper() if c.isupper() else new
        out.append(c)
    return "".join(out) + "".join(rest)


# -- on Spark -----------------------------------------------------------

def _mentions(texts: DataFrame) -> DataFrame:
    schema = pa.schema([("text_key", pa.binary()), ("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])

    def run(batches):
        seen: set = set()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("text_key").to_pylist(), each(batch.column("text")), strict=True):
                if key not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    rows += [(key, *m) for m in detect(text)]
            made = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, "text_key binary, begin int, end int, kind string, value string")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) with their surrogates."""
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "value", "attempt")), pa.array([surrogate(key, *r) for r in rows], pa.string())],
                                             ["kind", "value", "attempt", "canonical"])
    return entities.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, canonical string")


def distinct_surrogates(entities: DataFrame, key: bytes, name: str = "surrogates") -> DataFrame:
    """(kind, value, attempt, canonical) without any collision.  Persons'
    kinds carry gender and script, names of different kinds may agree."""
    now = materialize(_drawn(entities.withColumn("attempt", F.lit(0)), key), name)
    while True:
        owner = now.groupBy("kind", F.col("canonical").alias("taken")).agg(F.min("value").alias("owner"), F.count(F.lit(1)).alias("n"))
        clash = owner.where("n > 1").join(now.select("kind", "value", F.col("canonical").alias("taken")), ["kind", "taken"]).where("value <> owner").select("kind", "value")
        real = now.select("kind", F.col("canonical").alias("taken"), "value").join(
            now.select("kind", F.col("value").alias("taken")), ["kind", "taken"], "left_semi").select("kind", "value")
        # initials follow a permutation of their alphabet, whose letters are all in use
        again = materialize(clash.union(real).where("kind not like 'initial-%'").distinct(), f"{name}-again")
        if again.isEmpty():
            return now
        redrawn = _drawn(now.join(again, ["kind", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        now = materialize(now.join(again, ["kind", "value"], "left_anti").select("kind", "value", "attempt", "canonical").unionByName(redrawn), name)


def replace_pii(df: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """Input rows with the text's entities replaced, n_entities, and
    entities array<struct<start, end, kind, surrogate>> (places in the input
    text)."""
    own = [c for c in df.columns if c not in RESULT]
    named = {c: f"p6_{i}" for i, c in enumerate(own)}  # names of the input never meet ours
    # the text travels once; in its own place only whether there is one
    rows = df.select(*[(F.col(f"`{c}`").isNotNull() if c == text_col else F.col(f"`{c}`")).alias(n) for c, n in named.items()], whole_text(text_col).alias("text"))
    hit = functools.reduce(lambda a, t: a | F.col("text").contains(t), _TITLES_BEGIN, F.col("text").rlike(TRIGGER))
    hot = rows.where(hit).withColumn("text_key", text_key(F.col("text")))

    mentions = materialize(_mentions(hot.select("text_key", "text")), "mentions").distinct()
    surrogates = distinct_surrogates(mentions.select("kind", "value").distinct(), key)
    found = (mentions.join(surrogates.select("kind", "value", "canonical"), ["kind", "value"])
             .groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "kind", "canonical"))).alias("found")))
    joined = hot.join(found, "text_key", "left")

    entity = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())])
    carried = list(named.values())

    def swap(batches):
        for batch in by_bytes(batches, "text", 1 << 22):
            texts, n, entities = [], [], []
            for text, found in zip(each(batch.column("text")), each(batch.column("found")), strict=True):
                out, at, made = [], 0, []
                for e in found or ():
                    new = dress(e["kind"], e["canonical"], text[e["begin"]:e["end"]])
                    out += [text[at:e["begin"]], new]
                    at = e["end"]
                    made.append({"start": e["begin"], "end": e["end"], "kind": e["kind"].split("-")[0], "surrogate": new})
                texts.append("".join(out) + text[at:])
                n.append(len(made))
                entities.append(made)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(entities, pa.list_(entity))],
                                             [*carried, "text", *RESULT])

    types = "array<struct<start: int, end: int, kind: string, surrogate: string>>"
    added = T.StructType.fromDDL(f"text string, n_entities int, entities {types}")
    schema = T.StructType([*rows.drop("text").schema.fields, *added.fields])
    swapped = joined.select(*carried, "text", "found").mapInArrow(swap, schema)
    straight = rows.where(~hit).withColumns({"n_entities": F.lit(0), "entities": F.array().cast(types)})
    text = F.when(F.col(named[text_col]), F.col("text")).cast(df.schema[text_col].dataType)
    return straight.unionByName(swapped).select(*[(text if c == text_col else F.col(n)).alias(c) for c, n in named.items()], *RESULT)
