"""Surrogates for personal data: keyed, of the same kind, distinct and consistent.

Detected are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card and
other long account numbers, IBANs, US social security numbers, secrets (access keys,
tokens, passwords) and names of persons (a known given name or a form of address and
the capitalised words after it, of any letters, with initials and particles between
them; given names not in GIVEN are found after a form of address or a title only, and
count as family names). An initial ahead of a family name that the text has in full
(`J. Smith` beside `John Smith`) stands for that person. Telephone numbers
without separators count after a word for telephone, or where the same text has the number
in another form. Every entity has a canonical form; its surrogate
depends on that form and the key alone, so all mentions in all documents agree:

* digits become digits and letters letters of the same case, punctuation stays; card
  numbers keep their first digit and whether their check digit is right, IBANs their
  country and a right check number, telephone numbers their country prefix, addresses
  their range, e-mails end in a domain reserved for examples;
* an initial becomes the first letter of its person's surrogate where the text has that
  name, else another one, one to one; particles of a name stay;
* a given name becomes the next of its gender and script in an order set by the key,
  which is one to one; a family name becomes an invented one of the same script, and
  is replaced alone too where the document names the person in full.

Collisions are looked for over all entities of the corpus: of entities that share a
surrogate the one whose form sorts first keeps it, and none may be the form of a real
entity; the others try again with the next attempt, until nothing collides. Entities
beyond their first attempt are few; up to BROADCAST_ENTITIES they are sent to every
task, more are joined per document. Texts are not shuffled otherwise.

Defined cases: empty table, no rows; null text, null; empty text, empty; text without
entities, unchanged; null or repeated doc_id, each row by itself. Further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import stored

BROADCAST_ENTITIES = 500_000
#: From this attempt on a surrogate grows by a letter or digit, as its form has no free ones.
LONGER_FROM = 12
MOST_ATTEMPTS = 200

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Camille Carmen Charlotte Claire Elena Elisabeth Emily Emma Eva Hannah Helen Isabel Jessica Julia Karen Laura Linda Lucia Margaret Maria Marie Mary Monika Nancy Olivia Patricia Petra Sabine Sarah Sophie Susan Ursula",
    ("latin", "m"): "Alexander Andreas Antoine Antonio Bernard Carlos Charles Christopher Daniel David Diego Edward Emil Fernando Frank George Hans Henry Jacques James Javier John Jorge Joseph Karl Klaus Louis Manuel Mark Matthew Michael Miguel Oliver Pablo Patrick Paul Peter Philippe Pierre Robert Stefan Stephen Thomas William Wolfgang",
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Надежда Наталья Ольга Светлана Татьяна Юлия",
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей Юрий",
}
SYLLABLES = {
    "latin": "bar bel cor dan del fen gal har kel lan lor mar mel nor pal ran rol sal sen tar tel tor val ver vin wel".split(),
    "cyrillic": "бар бел вер вин гал дан зор кар лан лор мар мил нов пав рад рос сан тар тел тор".split(),
}
#: Letters, of which a name has one to one others.
INITIALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")
_LETTER = r"[^\W\d_][\u0300-\u036f]*"
_PART = re.compile(rf" ((?:{_LETTER})+(?:[-'’](?:{_LETTER})+)*)")
_PARTICLES = set("af al av bin da dal de del della den der des di do dos du e el ibn la las le los ten ter van von y zu zum zur".split())
_ELIDED = re.compile(r"(?:d|l|dell|dall)['’](?=(.))")
#: Forms of address and titles, which a name follows; those written in full take no point,
#: as a sentence may end with them.
SHORT_TITLES = "Mr Mrs Ms Miss Mx Dr dr Prof prof Rev Capt Lt Sgt Herr Herrn Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Srta г-н г-жа"
FULL_TITLES = "Sir Dame Doctor Professor Reverend Captain Judge Senator Mademoiselle Señorita"
_ADDRESSED = re.compile(
    r"(?<![\w-])(?:(?:" + "|".join(SHORT_TITLES.split()) + r")(?!\w)\.?|(?:" + "|".join(FULL_TITLES.split()) + r"))(?= )"
)
_BEFORE = re.compile(rf"(?<![\w.'’-])({_LETTER})(\.? |\.)$")
_GIVEN = {n: k for k, names in GIVEN.items() for n in names.split()}
_GIVEN_WORD = re.compile(r"(?<!\w)(?:" + "|".join(sorted(_GIVEN, key=len, reverse=True)) + r")(?![\w\u0300-\u036f])")

_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[^\W_](?:[\w-]{0,62})\.)+[^\W\d_]{2,24}(?![\w-])")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{1,4})?(?![\w:]|\.\d)")
_IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_NUMBER = re.compile(r"(?<![\w.,-])\d(?:[ -]?\d){12,18}(?![\w]|[.,-]\d)")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,8}){1,4}(?![\w]|[.-]\d)")
_DATE = re.compile(r"(?:19|20)\d\d[-. ][01]?\d[-. ][0-3]?\d(?!\d)|[0-3]?\d[-. ][01]?\d[-. ](?:19|20)\d\d(?!\d)")
_WIDE_PHONE = re.compile(r"(?<!\w)\+\d{8,15}(?!\w)")
_PLAIN_PHONE = re.compile(r"(?<![\w.,+-])\d{7,12}(?![\w]|[.,-]\d)")
_CALLED = re.compile(
    r"\b(?:tel|phone|telephone|mobile|cell|fax|call|sms|whatsapp|telefon|mobil|handy|anruf|tél|téléphone|teléfono|móvil)\b[^\w\n]{0,3}(?:(?:no|nr|number|is|at)\b[^\w\n]{0,3})?$",
    re.IGNORECASE,
)
_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<!\w)(?:ghp_|gho_|sk-|xox[bp]-)[\w-]{16,}")
_ASSIGNED = re.compile(
    r"\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?([^\s\"']{6,})", re.IGNORECASE
)


def _luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _ipv6(mention: str) -> str | None:
    """The address in full, or None if it is none. Names such as `add::bad` need a digit."""
    if not any(c.isdigit() for c in mention):
        return None
    try:
        return ipaddress.IPv6Address(mention).exploded
    except ValueError:
        return None


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of every entity, in order, none overlapping."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", m.group().casefold()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret", m.group(1)) for m in _ASSIGNED.finditer(text)]
        found += [(*m.span(), "ipv6", form) for m in _IPV6.finditer(text) if (form := _ipv6(m.group()))]
    if re.search(r"\d", text):
        found += [(*m.span(), "secret", m.group()) for m in _ACCESS.finditer(text)]
        found += [(*m.span(), "ipv4", m.group()) for m in _IPV4.finditer(text)]
        for m in _IBAN.finditer(text):
            plain = m.group().replace(" ", "")
            if _iban_rest(plain) == 1:
                found.append((*m.span(), "iban", plain))
        found += [(*m.span(), "ssn", _digits(m.group())) for m in _SSN.finditer(text)]
        found += [(*m.span(), "number", _digits(m.group())) for m in _NUMBER.finditer(text)]
        for m in (*_PHONE.finditer(text), *_WIDE_PHONE.finditer(text)):
            digits = _digits(m.group())
            marked = m.group().startswith("+") or "(" in m.group()
            if 7 <= len(digits) <= 15 and (marked or len(digits) >= 9 and not _DATE.match(m.group())):
                national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
                found.append((*m.span(), "phone", national))
        known = {x[3] for x in found if x[2] == "phone"}
        for m in _PLAIN_PHONE.finditer(text):
            digits = m.group()
            national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
            if national in known or _CALLED.search(text, max(0, m.start() - 40), m.start()):
                found.append((*m.span(), "phone", national))
    found += _names(text)
    found.sort(key=lambda x: (x[0], x[0] - x[1]))
    out: list[tuple[int, int, str, str]] = []
    for entity in found:
        if not out or entity[0] >= out[-1][1]:
            out.append(entity)
    return out


def _after(text: str, at: int) -> list[tuple[int, int, str, str]]:
    """The given names, initials and family names that follow each other from `at` on."""
    found: list[tuple[int, int, str, str]] = []
    while m := _PART.match(text, at):
        start, word = m.start(1), m.group(1)
        if word.endswith(("'s", "’s")):
            word = word[:-2]
        at = start + len(word)
        elided = _ELIDED.match(word)
        letter = unicodedata.normalize("NFD", word)[0]
        if word in _PARTICLES:
            if word in ("e", "y") and not any(x[2] == "family" for x in found):
                break
            continue
        if word in _GIVEN:
            found.append((start, at, "given", word))
        elif len(unicodedata.normalize("NFC", word)) == 1 and any(letter in x for x in INITIALS):
            found.append((start, at, "given", letter))
            at += text[at : at + 1] == "."
        elif word[0].isupper() or word[0].istitle() or (elided and elided.group(1).isupper()):
            found.append((start, at, "family", word))
        else:
            break
    return found


def _folded(family: str) -> str:
    return family.casefold().replace("’", "'")


def _names(text: str) -> list[tuple[int, int, str, str]]:
    found, families, end = [], set(), 0
    people: dict[tuple[str, str], str] = {}  # family name and initial -> given name
    for m in _GIVEN_WORD.finditer(text):
        rest = _after(text, m.end()) if m.start() >= end else []
        # An initial alone is no name: 'Anna I ...'.
        if any(len(x[3]) > 1 for x in rest):
            found += [(*m.span(), "given", m.group()), *(x for x in rest if x[2] == "given")]
            families.update(x[3] for x in rest if x[2] == "family")
            for family in (x[3] for x in rest if x[2] == "family"):
                people.setdefault((_folded(family), m.group()[0]), m.group())
            end = rest[-1][1]
    for m in _ADDRESSED.finditer(text):
        rest = _after(text, m.end())
        if any(len(x[3]) > 1 for x in rest):
            found += [x for x in rest if x[2] == "given"]
            families.update(x[3] for x in rest if x[2] == "family")
    found = list(dict.fromkeys(found))
    if families:
        either = {f.replace("’", "'") for f in families}
        either |= {f.replace("'", "’") for f in either}
        spaced = re.compile(r"(?<![\w-])(?:" + "|".join(map(re.escape, sorted(either, key=len, reverse=True))) + r")(?![\w\u0300-\u036f-])")
        for m in spaced.finditer(text):
            form = _folded(m.group())
            found.append((*m.span(), "family", form))
            initial = _BEFORE.search(text, max(0, m.start() - 5), m.start())
            if initial and (given := people.get((form, initial.group(1)))):
                found.append((*initial.span(1), "given", given))
    named = {x[3] for x in found if x[2] == "given" and len(x[3]) > 1}
    if named:
        # A given name that the document has in full is replaced where it stands alone.
        full = {x[:2] for x in found}
        found += [(*m.span(), "given", m.group()) for m in _GIVEN_WORD.finditer(text) if m.group() in named and m.span() not in full]
    return found


class Surrogates:
    """Canonical form -> canonical surrogate, and how a mention shows it."""

    def __init__(self, key: bytes):
        self.key = key
        self.given: dict[str, str] = {}
        for kind, names in GIVEN.items():
            order = sorted(names.split(), key=lambda n: self._bytes(f"order {kind}", n, 0)[:16])
            self.given.update(zip(order, order[1:] + order[:1], strict=True))
        for letters in INITIALS:
            order = sorted(letters, key=lambda n: self._bytes("order initials", n, 0)[:16])
            self.given.update(zip(order, order[1:] + order[:1], strict=True))

    def _bytes(self, kind: str, form: str, attempt: int, size: int = 32) -> bytes:
        out, block = b"", 0
        while len(out) < size:
            out += hmac.digest(self.key, f"{kind}\0{form}\0{attempt}\0{block}".encode(), hashlib.sha256)
            block += 1
        return out

    def _shaped(self, form: str, noise: bytes) -> str:
        out = []
        for c, b in zip(form, noise, strict=False):
            if c.isdecimal():
                out.append(str(b % 10))
            elif c.isalpha():
                out.append(chr(ord("a") + b % 26) if c.islower() or not c.isupper() else chr(ord("A") + b % 26))
            else:
                out.append(c)
        return "".join(out)

    def __call__(self, kind: str, form: str, attempt: int) -> str:
        if kind == "given":
            return self.given[form]
        noise = self._bytes(kind, form, attempt, 2 * len(form) + 32)
        more = "".join(str(b % 10) for b in noise[-8:][: max(0, attempt - LONGER_FROM + 1)])
        if kind == "family":
            script = "cyrillic" if re.search("[а-яё]", form) else "latin"
            parts = SYLLABLES[script]
            many = 2 + (len(form) > 7) + max(0, attempt - 3)
            return "".join(parts[b % len(parts)] for b in noise[:many])
        if kind == "email":
            local, host = form.rsplit("@", 1)
            labels = host.split(".")
            kept = [self._shaped(x, noise[len(local) + 7 * i :]) for i, x in enumerate(labels[:-2])]
            end = ("example.com", "example.net", "example.org")[noise[-9] % 3]
            return f"{self._shaped(local, noise)}{more}@{'.'.join([*kept, end])}"
        if kind == "ipv4":
            a, b = (int(x) for x in form.split(".")[:2])
            rest = [str(noise[i] % 254 + 1) for i in range(4)]
            if attempt < LONGER_FROM and (a in (10, 127) or (a, b) == (192, 168)):
                keep = 2 if a == 192 else 1
                return ".".join([*form.split(".")[:keep], *rest[keep:]])
            first = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192, 198)]
            return ".".join([str(first[noise[4] % len(first)]), *rest[1:]])
        if kind == "ipv6":
            return ":".join(["2001", "db8", *(f"{noise[2 * i] << 8 | noise[2 * i + 1]:x}" for i in range(6))])
        if kind == "number":
            body = form[0] + "".join(str(b % 10) for b in noise[: len(form) - 2])
            right = next(d for d in "0123456789" if _luhn(body + d) == 0)
            return body + (right if _luhn(form) == 0 else str((int(right) + 1 + noise[-9] % 9) % 10))
        if kind == "iban":
            body = self._shaped(form[4:], noise)
            check = 98 - _iban_rest(form[:2] + "00" + body)
            return f"{form[:2]}{check:02d}{body}"
        if kind == "ssn":
            if attempt >= LONGER_FROM:
                return "".join(str(b % 10) for b in noise[:9])
            return f"{noise[0] % 99 + 900}{noise[1] % 99 + 1:02d}{(noise[2] << 8 | noise[3]) % 9999 + 1:04d}"
        if kind == "phone":
            body = "".join(str(b % 10) for b in noise[: len(form)])
            return str(2 + noise[-9] % 8) + body[1:] if len(form) == 10 else form[: len(form) - 7] + body[-7:]
        if re.fullmatch(r"[0-9a-f]+", form):
            return "".join(str(b % 10) if c.isdigit() else "abcdef"[b % 6] for c, b in zip(form, noise, strict=False)) + more
        head = re.match(r"AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|", form).group()
        return head + self._shaped(form[len(head) :], noise) + more

    @staticmethod
    def shown(kind: str, mention: str, surrogate: str) -> str:
        """The surrogate in the format of the mention."""
        if kind in ("phone", "number", "ssn", "iban"):
            # Digits (of an IBAN, letters too) go into their places from the right.
            rest, out = list(surrogate), []
            for c in reversed(mention):
                out.append(rest.pop() if rest and c.isalnum() else c)
            return "".join(reversed(out))
        if mention.isupper() and kind in ("email", "family", "ipv6"):
            return surrogate.upper()
        if kind == "family":
            return surrogate.capitalize()
        if kind == "given" and len(unicodedata.normalize("NFC", mention)) == 1:
            return surrogate[0]
        return surrogate


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {(kind, form) for text in batch.column(0).to_pylist() if text for _, _, kind, form in find(text)}
        kind, form = zip(*sorted(seen), strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(form, pa.string())], ["kind", "form"])


def attempts(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt, surrogate) of every entity in `docs`, without collisions."""
    make = Surrogates(key)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, form, attempt = (batch.column(i).to_pylist() for i in range(3))
            found = pa.array([make(*x) for x in zip(kind, form, attempt, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], ["kind", "form", "attempt", "surrogate"])

    def with_surrogates(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(named, "kind string, form string, attempt int, surrogate string")

    every = stored(docs.select("text").mapInArrow(_entities, "kind string, form string").distinct(), "entities")
    table = stored(with_surrogates(every.withColumn("attempt", F.lit(0))), "surrogates")
    real = every.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("_real"))
    for _ in range(MOST_ATTEMPTS):
        # Given names are one to one by construction.
        open_ = table.filter("kind <> 'given'")
        owner = open_.groupBy("kind", "surrogate").agg(F.min("form").alias("_owner"))
        judged = open_.join(owner, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        lost = judged.filter((F.col("form") != F.col("_owner")) | F.col("_real"))
        again = stored(with_surrogates(lost.select("kind", "form", (F.col("attempt") + 1).alias("attempt"))), "again")
        if again.isEmpty():
            return table
        table = stored(table.join(again, ["kind", "form"], "left_anti").unionByName(again), "surrogates")
    raise ValueError(f"no free surrogates after {MOST_ATTEMPTS} attempts")


def replace(docs: DataFrame, key: bytes, most: int = BROADCAST_ENTITIES) -> DataFrame:
    """Per row of `docs`: doc_id, text with surrogates, n_entities, kinds (sorted)."""
    later = stored(attempts(docs, key).filter("attempt > 0").select("kind", "form", "attempt"), "later")
    make = Surrogates(key)
    doc = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text", "n_entities", "kinds"]

    def rewrite(doc_id: pa.Array, texts: pa.Array, later_of) -> pa.RecordBatch:
        out, count, kinds = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            parts, at, found = [], 0, find(text) if text else []
            tries = later_of(i)
            for start, end, kind, form in found:
                surrogate = make(kind, form, tries.get((kind, form), 0))
                parts += [text[at:start], make.shown(kind, text[start:end], surrogate)]
                at = end
            out.append("".join([*parts, text[at:]]) if found else text)
            count.append(len(found))
            kinds.append(sorted({x[2] for x in found}))
        columns = [doc_id, pa.array(out, pa.string()), pa.array(count, pa.int32()), pa.array(kinds, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {doc}, text string, n_entities int, kinds array<string>"
    if later.count() <= most:
        tries = {(r["kind"], r["form"]): r["attempt"] for r in later.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(tries)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rewrite(batch.column(0), batch.column(1), lambda _: shared.value)

        return docs.select("doc_id", "text").mapInArrow(scan, schema)

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, *e) for r, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) if t for e in {x[2:] for x in find(t)}]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "kind", "form"])

    # Rows with equal texts need the same attempts, so the text's hash names them.
    row = F.xxhash64("text").alias("row")
    asked = docs.select(row, "text").mapInArrow(mentions, "row long, kind string, form string").distinct()
    per_row = asked.join(later, ["kind", "form"]).groupBy("row").agg(F.collect_set(F.struct("kind", "form", "attempt")).alias("tries"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tries = [{(x["kind"], x["form"]): x["attempt"] for x in t or ()} for t in batch.column(2).to_pylist()]
            yield rewrite(batch.column(0), batch.column(1), tries.__getitem__)

    rows = docs.select(row, "doc_id", "text").join(per_row, "row", "left").select("doc_id", "text", "tries")
    return rows.mapInArrow(joined, schema)
