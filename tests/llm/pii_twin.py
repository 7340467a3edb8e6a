"""Pseudonyms in plain Python, one text at a time, to hold the column expressions against."""

import datetime
import hashlib
import re

from flockline.llm import pii

FIRST = datetime.date(1900, 1, 1)


def shift(half, other, key, i):
    digest = hashlib.sha512(f"{key}|{i}|{''.join(other)}".encode()).hexdigest()
    out = []
    for n, c in enumerate(half):
        step = int(digest[4 * n : 4 * n + 4], 16)
        for low, size in (("0", 10), ("a", 26), ("A", 26)):
            if 0 <= ord(c) - ord(low) < size:
                c = chr(ord(low) + (ord(c) - ord(low) + step) % size)
                break
        out.append(c)
    return out


def chars(text, key):
    left, right = list(text[: len(text) // 2]), list(text[len(text) // 2 :])
    for i in range(1, pii.CHAR_ROUNDS + 1):
        if i % 2:
            right = shift(right, left, key, i)
        else:
            left = shift(left, right, key, i)
    return "".join(left + right)


def number(n, a, b, key):
    left, right = divmod(n, b)
    stream = lambda x, i: int(hashlib.sha256(f"{key}|{i}|{x}".encode()).hexdigest()[:12], 16)
    for i in range(1, pii.RANGE_ROUNDS + 1):
        if i % 2:
            right = (right + stream(left, i)) % b
        else:
            left = (left + stream(right, i)) % a
    return left * b + right


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def refill(form, filling, class_):
    it = iter(filling)
    return "".join(next(it) if re.match(class_, c) else c for c in form)


def pseudonym(m, key):
    for kind in pii.PATTERNS:
        if kind == "card" or re.fullmatch(pii.PATTERNS[kind], m, re.ASCII):
            break
    key = f"{key}|{kind}"
    digits = re.sub(r"\D", "", m)
    if kind == "email":
        local, domain = m.split("@")
        return f"{chars(local, key)}@{domain}"
    if kind == "iban":
        flat = m.replace(" ", "")
        if mod97(flat[4:] + flat[:4]) != 1:
            return m
        body = chars(flat[4:], key)
        return refill(m, f"{flat[:2]}{98 - mod97(body + flat[:2] + '00'):02d}{body}", "[A-Z0-9]")
    if kind == "ip":
        n = number(int.from_bytes(bytes(map(int, m.split("."))), "big"), 65536, 65536, key)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return m
        n = number((area - 1 - (area > 666)) * pii.SERIALS + (group - 1) * 9999 + serial - 1, pii.AREAS, pii.SERIALS, key)
        area, rest = divmod(n, pii.SERIALS)
        area += 1
        return f"{area + (area >= 666):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    if kind == "date":
        form = "%Y-%m-%d" if m[4] == "-" else "%m/%d/%Y" if "/" in m else "%d.%m.%Y"
        try:
            rank = (datetime.datetime.strptime(m, form).date() - FIRST).days
        except ValueError:
            return m
        if not 0 <= rank < pii.DAYS[0] * pii.DAYS[1]:
            return m
        return (FIRST + datetime.timedelta(number(rank, *pii.DAYS, key))).strftime(form)
    if kind == "phone":
        return refill(m, digits[:-10] + chars(digits[-10:], key), r"\d")
    if luhn(digits) % 10:
        return m
    body = chars(digits[:-1], key)
    return refill(m, f"{body}{-luhn(body + '0') % 10}", r"\d")


def rank(part):
    flat, digits = part.replace(" ", ""), re.sub(r"\D", "", part)
    if re.fullmatch(pii.PATTERNS["iban"], part, re.ASCII):
        return None if mod97(flat[4:] + flat[:4]) != 1 else 0 if f"{flat[:2]}{len(flat)}" in pii.IBAN_LENGTHS.split() else 2
    ssn, day = re.fullmatch(r"(\d{3})-(\d\d)-(\d{4})", part), re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", part)
    if ssn and ssn[1] not in ("000", "666") and ssn[1][0] != "9" and ssn[2] != "00" and ssn[3] != "0000":
        return 1
    if day and day[1][:2] in ("19", "20") and 1 <= int(day[2]) <= 12 and 1 <= int(day[3]) <= 31:
        return 1
    if re.fullmatch(pii.PATTERNS["phone"], part, re.ASCII):
        return 2
    if re.fullmatch("[0-9 -]+", part) and 13 <= len(digits) <= 19 and luhn(digits) % 10 == 0:
        return 1 if re.match(pii.USUAL_CARD, part) else 3
    return None


def split_run(m):
    bits = re.findall("[A-Z0-9]+|[ -]", m)
    last, until, out = (len(bits) - 1) // 2, -1, []
    for begin in range(0, last + 1, pii.STRETCH):
        end, found, taken = min(begin + pii.STRETCH - 1, last), [], []
        for i in range(max(begin, until + 1), end + 1):
            for j in range(i, min(i + pii.WIDEST - 1, last) + 1):
                text = "".join(bits[2 * i : 2 * j + 1])
                if pii.LENGTHS[0] <= len(text) <= pii.LENGTHS[1] and (r := rank(text)) is not None:
                    found.append((r, -len(text), i, j, text))
        for p in sorted(found):
            if all(p[3] < t[2] or t[3] < p[2] for t in taken):
                taken.append(p)
        for at in range(2 * begin, min(2 * end + 1, 2 * last) + 1):
            here = [p for p in taken if 2 * p[2] <= at <= 2 * p[3]]
            if at > 2 * until and not here:
                out.append((bits[at], False))
            elif here and 2 * here[0][2] == at:
                out.append((here[0][4], True))
        until = max([until, *(p[3] for p in taken)])
    return out


def pseudonymise(text, key=pii.KEY):
    """(text, n_found, n_replaced)"""
    found = changed = 0

    def replace(m):
        nonlocal found, changed
        is_run = not any(re.fullmatch(pii.PATTERNS[k], m[0], re.ASCII) for k in pii.PATTERNS if k not in pii.RUNS)
        pieces = split_run(m[0]) if is_run else [(m[0], True)]
        found += max(1, sum(n for _, n in pieces))
        made = [pseudonym(t, key) if n else t for t, n in pieces]
        changed += sum(a != t for a, (t, _) in zip(made, pieces, strict=True))
        return "".join(made)

    return (None if text is None else re.sub(pii.PATTERN, replace, text, flags=re.ASCII)), found, changed
