"""Personal data by weak supervision.

Exact patterns give base spans (email, ip, card, phone), which always stay. Wider candidates (secrets given to a
named key, long keys, account numbers, mail addresses written out, dates of birth, street addresses) are voted on by
labelers: a pattern labeler on the value's form and check digits, a gazetteer labeler on what the value itself holds
(starts of service keys, bank countries, mail hosts, months, kinds of streets), a context labeler on the words before
it and one on the signs around it; each votes yes, no or abstains. Vote patterns are counted over all documents,
expectation maximisation estimates the labelers' reliabilities (Dawid and Skene, 1979; with a prior that they are
better than chance), and a naive Bayes span classifier is trained on the posteriors of candidate features, over all
candidates. Candidates that the classifier accepts and that overlap no base span are added; no vote overrules it.

Candidates have the bounds of their kinds: account numbers are of at most 34 signs, dates of birth stand within
BIRTH_REACH signs after a word that says so. Words and written-out addresses may be of any length.

Cases: null and empty texts have no spans; very long texts are searched whole; repeated rows each get a row; of
overlapping candidates the earlier, then the longer one, counts, then the one first in EXTRA; an empty table gives an
empty result; further columns are not carried by find_pii and kept by mask_pii.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import modest_batches, table
from .tokens import forget_encoders, text_slices

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("account", "birth", "secret", "contact", "address")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Words that announce personal data.
SECRET_WORDS = {"password", "passwd", "passwort", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "secret_key", "private_key", "auth", "key", "credential", "clave", "contraseña", "motdepasse", "pin"}
ACCOUNT_WORDS = {"ssn", "iban", "account", "passport", "konto", "cuenta", "compte", "tel", "phone", "telefon", "teléfono", "téléphone", "mobile", "fax", "id", "licence", "license"}
#: How keys of widely used services begin.
KEY_STARTS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "npm_", "hf_")

#: Countries whose bank accounts are written as IBAN, with the length of theirs.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24}
#: Hosts of private mail.
MAIL_HOSTS = {"gmail", "googlemail", "yahoo", "hotmail", "outlook", "live", "icloud", "aol", "gmx", "web", "protonmail", "proton", "orange", "free", "laposte", "telefonica", "example"}
#: Months in four languages, and kinds of streets.
MONTHS = "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
STREETS_AFTER = "street st avenue ave road rd lane ln drive dr boulevard blvd court ct square terrace".split()
STREETS_BEFORE = "rue avenue boulevard place allée chemin calle avenida plaza paseo camino carrera".split()
STREETS_IN = "straße strasse str. weg platz allee gasse ring damm".split()
BIRTH_WORDS = "born dob birth birthday birthdate geboren geburtsdatum geburtstag née né naissance nacido nacida nacimiento".split()
ADDRESS_WORDS = {"at", "address", "lives", "live", "living", "in", "adresse", "wohnt", "wohnhaft", "anschrift", "domicilio", "dirección", "vive", "habite", "demeurant", "home"}
BIRTH_REACH = 40

#: A candidate's rare part is sought first; the words before it are then read backwards.
_GIVEN = re.compile(r"[:=]\s{0,2}[\"']?(?P<value>[A-Za-z0-9_+/.=-]{6,})")
_GIVEN_TO = re.compile(r"(?P<word>[^\W\d][\w-]*)[\"']?\s{0,2}\Z")
_DIGITS = re.compile(r"[0-9]+")
_KEY = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
_KEY_BEFORE = re.compile(r"[A-Za-z0-9_+/-]*\Z")
_NUMBER = re.compile(r"(?P<value>[A-Z]{0,2}[0-9][0-9A-Z -]{5,32}[0-9A-Z])")
_NUMBER_OF = re.compile(r"(?P<word>[^\W\d]{2,})[.:#]?\s{1,2}(?:no\.?\s)?\Z")
_IBAN = re.compile(r"(?P<value>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,6}(?:[ ]?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_AT = re.compile(r"[\[(]at[\])]\s?(?P<host>[A-Za-z0-9-]+)\s?(?:[\[(]dot[\])]|\.)\s?[A-Za-z]{2,}", re.IGNORECASE)
_BEFORE_AT = re.compile(r"[A-Za-z0-9._-]+\s?\Z")
_BIRTH = re.compile(r"\b(?P<word>" + "|".join(BIRTH_WORDS) + r")\b[^\n]*\Z", re.IGNORECASE)
_DATE = re.compile(r"[0-9]{1,4}(?:(?<=[0-9])[./-][0-9]{1,2}[./-](?:[0-9]{4}|[0-9]{2})|(?:st|nd|rd|th|\.)?\s(?:de\s)?(?P<month>" + "|".join(MONTHS) + r")\s(?:de\s)?[0-9]{4}|,?\s[0-9]{4})(?!\w)", re.IGNORECASE)
_MONTH_BEFORE = re.compile(r"\b(?P<month>" + "|".join(MONTHS) + r")\s\Z", re.IGNORECASE)
_YEAR = re.compile(r"(?:18[9]|19[0-9]|20[0-2])[0-9]")
_STREET = re.compile(r"[0-9]{1,5}[a-z]?,?\s(?:(?:[^\W\d_][\w'-]*\s){1,3}(?:" + "|".join(STREETS_AFTER) + r")\b|(?:" + "|".join(STREETS_BEFORE) + r")\s(?:(?:de|du|des|la|las|los|el)\s){0,2}[^\W\d_][\w'-]*)", re.IGNORECASE)
_HOUSE = re.compile(r"[0-9]{1,4}[a-z]?(?!\w)")
_STREET_BEFORE = re.compile(r"[^\W\d_]*(?:" + "|".join(map(re.escape, STREETS_IN)) + r")\s\Z", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each match holds the first @ after its local part, so only the runs of local characters before an @ can begin one."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        low = max(last, at - 64)
        begin = _LOCAL.search(text, low, at).start()
        while begin == low and low > last:
            low = max(last, low - 4096)
            begin = _LOCAL.search(text, low, at).start()
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _is_ip(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    card = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            card.append(m.span())
    return {
        "email": _emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if _is_ip(m[0])],
        "card": card,
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else [],
    }


def _entropy(value: str) -> float:
    n = np.array(list(Counter(value).values()), float) / len(value)
    return float(-(n * np.log2(n)).sum())


def _before(pattern: re.Pattern, text: str, end: int):
    """The match of a pattern that ends at end, read backwards in a window that grows until the match lies within."""
    size = 80
    while True:
        low = max(0, end - size)
        w = pattern.search(text[low:end])
        if w is None or w.start() > 0 or low == 0:
            return w
        size *= 8


def _after(what: re.Pattern, before: re.Pattern, text: str):
    """Matches of `what` that end what `before` describes, each with its match of `before`."""
    for m in what.finditer(text):
        if w := _before(before, text, m.start()):
            yield m, w


def _mod_97(value: str) -> bool:
    value = value.replace(" ", "")
    return len(value) == IBAN_LENGTHS[value[:2]] and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _near_digits(text: str):
    """Matches of the patterns that begin at a run of digits, or up to two capitals before it; none overlap of its own kind."""
    after = dict.fromkeys(("key", "iban", "number", "date", "street", "house"), 0)

    def take(name, pattern, at):
        if at >= after[name] and (m := pattern.match(text, at)):
            after[name] = m.end()
            return [(name, m)]
        return []

    for run in _DIGITS.finditer(text):
        d = run.start()
        if d >= after["key"]:
            low, size = d, 64
            while True:
                edge = max(after["key"], d - size)
                low = _KEY_BEFORE.search(text, edge, d).start()
                if low > edge or edge == after["key"]:
                    break
                size *= 8
            yield from take("key", _KEY, low)
            after["key"] = max(after["key"], run.end())
        first = d
        while first > max(0, d - 2) and "A" <= text[first - 1] <= "Z":
            first -= 1
        if first and text[first - 1].isspace():
            yield from take("number", _NUMBER, first)
        if text[max(0, d - 2) : d] in IBAN_LENGTHS and (d == 2 or not text[d - 3].isalnum()):
            yield from take("iban", _IBAN, d - 2)
        if d == 0 or not (text[d - 1].isalnum() or text[d - 1] in "._"):
            yield from take("date", _DATE, d)
            yield from take("street", _STREET, d)
            if d and text[d - 1].isspace():
                yield from take("house", _HOUSE, d)


def _found(text: str) -> list[tuple[int, int, str, str, int, int]]:
    """(start, end, kind, word before, votes of pattern and gazetteer) of all candidates; a pattern's 2 is decided later."""
    found, streets = [], []
    if "=" in text or ":" in text:
        found += [(*m.span("value"), "secret", w["word"].lower(), 2, 1 if m["value"].startswith(KEY_STARTS) else 0) for m, w in _after(_GIVEN, _GIVEN_TO, text)]
    if "[" in text or "(" in text:
        found += [(m.start() - len(w[0]), m.end(), "contact", "", 1, 1 if m["host"].lower() in MAIL_HOSTS else 0) for m, w in _after(_AT, _BEFORE_AT, text)]
    for name, m in _near_digits(text):
        if name == "key":
            found.append((*m.span(), "secret", "", 2, 1 if m[0].startswith(KEY_STARTS) else 0))
        elif name == "iban":
            w = _before(_NUMBER_OF, text, m.start())
            found.append((*m.span("value"), "account", w["word"].lower() if w else "", 1 if _mod_97(m["value"]) else -1, 1))
        elif name == "number":
            if w := _before(_NUMBER_OF, text, m.start()):
                found.append((*m.span("value"), "account", w["word"].lower(), 2, 0))
        elif name == "date":
            month = _MONTH_BEFORE.search(text, max(0, m.start() - 12), m.start())
            first = month.start() if month else m.start()
            if word := _BIRTH.search(text, max(0, first - BIRTH_REACH), first):
                found.append((first, m.end(), "birth", word["word"].lower(), 1 if _YEAR.search(m[0]) else -1, 1 if month or m["month"] else 0))
        elif name == "street":
            streets.append(m.span())
        elif w := _STREET_BEFORE.search(text, max(0, m.start() - 60), m.start()):
            streets.append((m.start() - len(w[0]), m.end()))
    for a, b in streets:
        w = _before(_NUMBER_OF, text, a)
        found.append((a, b, "address", w["word"].lower() if w else "", 1 if any(c.isupper() for c in text[a:b]) else -1, 1))
    return sorted(found, key=lambda x: x[4] == 2)  # of two on the same signs the one with a sure pattern comes first


_ANNOUNCING = {"secret": SECRET_WORDS, "account": ACCOUNT_WORDS, "birth": set(BIRTH_WORDS), "address": ADDRESS_WORDS, "contact": set()}


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, vote and feature pattern) of what may be personal besides the base spans; none overlap."""
    out, last = [], -1
    for a, b, kind, word, form, listed in sorted(_found(text), key=lambda x: (x[0], -x[1], EXTRA.index(x[2]), x[3] == "")):
        if a < last:
            continue
        last = b
        value, before = text[a:b], text[max(0, a - 3) : a]
        digits, upper = sum(c.isdigit() for c in value), sum(c.isupper() for c in value)
        rich = _entropy(value)
        if form == 2:
            strong = (kind == "secret" and digits >= 2 and digits < len(value) and rich >= 2.5 and len(value) >= 8) or (kind == "account" and digits >= 8)
            form = 1 if strong else -1 if digits == 0 or rich < 1.5 else 0
        names = _ANNOUNCING[kind]
        announced = 1 if word in names or any(w in names for w in re.split(r"[_-]", word)) else 0 if not word else -1
        around = 1 if re.search(r"[=:\"'#]\s?$", before) else 0 if kind in ("contact", "birth", "address") or not before.strip() else -1
        hexadecimal = bool(re.fullmatch(r"[0-9a-fA-F-]+", value))
        features = (kind, "hex" if hexadecimal else "mixed", min(len(value) // 8, 5), round(2 * rich) // 2, min(3, 4 * digits // len(value)), upper > 0, form, listed, announced, around)
        out.append((a, b, kind, f"{form},{listed},{announced},{around}|{'/'.join(map(str, features))}"))
    return out


def _count_patterns(batches):
    import pyarrow as pa

    forget_encoders()
    total: Counter = Counter()
    for batch in batches:
        for _, _, texts in text_slices(batch):
            for t in texts:
                total.update(p for *_, p in candidates(t))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])


def estimate(votes: dict[tuple[int, ...], float], rounds: int = 50, trust: float = 0.1) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of each vote pattern and, for no and yes, each labeler's rates of voting -1, 0 and 1.

    trust: weight of the prior, as a share of all candidates, that a labeler says yes or abstains of what is personal
    and no or abstains of what is not.
    """
    patterns = sorted(votes)
    n, v = np.array([votes[p] for p in patterns], float), np.array(patterns) + 1
    p = 1 / (1 + np.exp(-2.0 * (v - 1).sum(1)))  # majority to begin with
    rates = np.zeros((2, v.shape[1], 3))
    believed = (1 + trust * n.sum()) * np.array([[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]])
    for _ in range(rounds):
        for y, w in ((0, n * (1 - p)), (1, n * p)):
            for k in range(v.shape[1]):
                counts = np.bincount(v[:, k], weights=w, minlength=3) + believed[y]
                rates[y, k] = counts / counts.sum()
        prior = (n @ p + 1) / (n.sum() + 2)
        logs = np.log(rates)
        odds = np.log(prior / (1 - prior)) + sum(logs[1, k, v[:, k]] - logs[0, k, v[:, k]] for k in range(v.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(patterns, p.tolist(), strict=True)), rates


def train(patterns: dict[str, int]) -> set[str]:
    """The patterns that the span classifier accepts."""
    if not patterns:
        return set()
    split = {p: (tuple(map(int, p.split("|")[0].split(","))), p.split("|")[1].split("/")) for p in patterns}
    votes: Counter = Counter()
    for p, n in patterns.items():
        votes[split[p][0]] += n
    posterior, _ = estimate(votes)
    yes, no, total = Counter(), Counter(), np.ones(2)
    for p, n in patterns.items():
        q = posterior[split[p][0]]
        total += (n * (1 - q), n * q)
        for feature in enumerate(split[p][1]):
            yes[feature] += n * q
            no[feature] += n * (1 - q)
    accepted = set()
    for p, (_, features) in split.items():
        odds = np.log(total[1] / total[0]) + sum(np.log((yes[f] + 0.5) / (total[1] + 1)) - np.log((no[f] + 0.5) / (total[0] + 1)) for f in enumerate(features))
        if odds > 0:
            accepted.add(p)
    return accepted


def fit(docs: DataFrame) -> set[str]:
    """Accepted patterns; their number is bounded by the features' values, not by the documents."""
    rows = docs.select("text").mapInArrow(_count_patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n")).collect()
    return train(dict(map(tuple, rows)))


def all_spans(text: str, accepted: set[str]) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans by kind and added spans by kind."""
    base, extra = base_spans(text), {k: [] for k in EXTRA}
    taken = sorted(s for spans in base.values() for s in spans)
    for a, b, kind, pattern in candidates(text):
        if pattern in accepted and not any(x < b and a < y for x, y in taken):
            extra[kind].append((a, b))
    return base, extra


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)


def _find(accepted: set[str]):
    def run(batches):
        import pyarrow as pa

        forget_encoders()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, texts in text_slices(batch):
                counts, digests, listed, many = [], [], [], []
                for t in texts:
                    base, extra = all_spans(t, accepted)
                    counts.append([len(base[k]) for k in KINDS])
                    digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                    listed.append(_listed(base | extra))
                    many.append(sum(map(len, (base | extra).values())))
                columns = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), *columns, pa.array(digests), pa.array(listed), pa.array(many, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans as kind:start:end (code points) and their number."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_find(fit(docs)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def _mask(accepted: set[str]):
    def run(batches):
        import pyarrow as pa

        forget_encoders()
        for batch in batches:
            at, size = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            texts = []
            for t in batch.column(at).to_pylist():
                base, extra = all_spans(t or "", accepted)
                last, out = 0, []
                for a, b, kind in sorted((a, b, k) for k, found in (base | extra).items() for a, b in found):
                    if b > last:
                        out += [t[last : max(a, last)], f"[{kind.upper()}]" if a >= last else ""]
                        last = b
                texts.append(t if t is None else "".join([*out, t[last:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size >= 0:
                columns[size] = pa.array([n if t is None else len(t) for n, t in zip(columns[size].to_pylist(), texts, strict=True)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and n_chars, if there, of the new text."""
    return docs.mapInArrow(_mask(fit(docs)), docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(modest_batches(spark), sf_dir, "documents"))
