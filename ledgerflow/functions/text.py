"""Text functions of the ledger: cleaning, keys, merchant names, families, tokens."""

from __future__ import annotations

from ledgerflow.functions import vocabulary as v
from ledgerflow.functions.dialect import Dialect

SPACES = r"\s+"

#: Accented letters of Latin-1 and what is left of each after decomposition.
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def optional(d: Dialect, x: str) -> str:
    """Blank is null."""
    return f"nullif(trim({x}), '')"


def cleaned(d: Dialect, x: str) -> str:
    """White space squeezed; blank or null is 'Unknown'."""
    return f"coalesce({optional(d, d.replaced(x, SPACES, ' '))}, 'Unknown')"


def normalised(d: Dialect, x: str) -> str:
    """Lower-case letters and digits of ASCII between single blanks; accents are taken off, other characters left out."""
    plain = d.replaced(f"translate(coalesce({x}, ''), '{_ACCENTED}', '{_PLAIN}')", r"[^\x00-\x7F]", "")
    return f"trim({d.replaced(f'lower({plain})', '[^a-z0-9]+', ' ')})"


def merchant_key(d: Dialect, merchant: str, description: str, raw: str) -> str:
    """The key under which corrections of a merchant are remembered."""
    name = f"coalesce(nullif({merchant}, ''), nullif({description}, ''), {raw})"
    key = normalised(d, name)
    for suffix in v.KEY_SUFFIXES:
        key = f"trim({d.replaced(key, suffix + '$', '')})"
    key = d.replaced(key, rf"\b({'|'.join(v.KEY_COMPANY_WORDS)})\b", " ")
    return f"trim({d.replaced(key, ' +', ' ')})"


def display_name(d: Dialect, name: str) -> str:
    """Each word with a capital first letter."""
    words = d.each(d.split(name), lambda w: f"concat(upper(substr({w}, 1, 1)), lower(substr({w}, 2)))")
    return d.joined(words)


def _brand(d: Dialect, x: str, otherwise: str) -> str:
    return d.first_case([(f"starts_with({x}, {d.text(k)})" if not d.spark else f"startswith({x}, {d.text(k)})", d.text(n)) for k, n in v.KNOWN_BRANDS.items()], otherwise)


def merchant_columns(d: Dialect, description: str) -> list[tuple[str, str]]:
    """Steps of merchant normalisation, each of which may refer to those before it: the last two are ``merchant_name``
    and ``merchant_score``.

    System phrases have no merchant (0.99), known brands score 0.95; else terminal prefixes, descriptive phrases and
    company words go, words after the first place or area word too, and what is left is capitalised.
    """
    spaced = lambda phrase: phrase.replace(" ", r"\s+")
    system = rf"\b({'|'.join(spaced(p) for p in v.SYSTEM_PHRASES)})\b"
    upper = f"upper(trim({description}))"
    stripped = upper
    for prefix in v.TERMINAL_PREFIXES:
        stripped = d.replaced(stripped, "^" + prefix, "")
    stripped = f"trim({d.replaced(stripped, SPACES, ' ')})"
    cut = "m_clean"
    for phrase in v.DESCRIPTOR_PHRASES:
        pattern = rf"\b{spaced(phrase)}\b.*$"
        cut = f"trim({d.replaced(cut, pattern, '')})"
    words = d.kept(d.split(cut), lambda w: f"{w} <> '' and not ({d.one_of(w, v.COMPANY_WORDS)})")
    first = d.place(d.each("m_words", lambda w: d.one_of(w, v.PLACE_WORDS + v.AREA_WORDS)), "true")
    head = f"case when m_stop > 1 then {d.head('m_words', 'm_stop - 1')} else m_words end"
    tail = d.replaced(d.replaced(d.joined("m_head"), r"\s+FOR$", ""), r"^[ \-*_.,]+|[ \-*_.,]+$", "")
    shown = f"nullif({display_name(d, 'm_tail')}, '')"
    name = f"case when m_system or m_clean = '' then null else {_brand(d, 'm_clean', _brand(d, 'm_tail', shown))} end"
    brand = " or ".join((f"startswith({x}, {d.text(k)})" if d.spark else f"starts_with({x}, {d.text(k)})") for x in ("m_clean", "m_tail") for k in v.KNOWN_BRANDS)
    longer = f"case when length(trim({description})) > length(merchant_name) then 5 else 0 end"
    few = f"case when {d.size(d.split('merchant_name'))} <= 4 then 5 else 0 end"
    score = f"case when m_system then 0.99D when merchant_name is null then 0.0D when {brand} then 0.95D else cast(80 + {longer} + {few} as double) / 100 end"
    return [
        ("m_system", f"coalesce({d.matches(upper, system)}, false)"),
        ("m_clean", f"coalesce({stripped}, '')"),
        ("m_words", words),
        ("m_stop", first),
        ("m_head", head),
        ("m_tail", tail),
        ("merchant_name", name),
        ("merchant_score", score if d.spark else score.replace("D ", " ").replace("D else", " else")),
    ]


def family_key(d: Dialect, x: str) -> str:
    """A merchant's name without company, place and number words."""
    text = f"replace(lower(trim(coalesce({x}, ''))), '&', ' and ')"
    text = d.replaced(text, "[’'`´]", "")
    text = d.replaced(text, rf"\b({'|'.join(v.FAMILY_NOISE)})\b", " ")
    text = d.replaced(text, r"\b[0-9]+[a-z]*\b", " ")
    return f"trim({d.replaced(text, SPACES, ' ')})"


def family(d: Dialect, key: str) -> str:
    """The known family of a family key, else the key itself."""
    starts = "startswith" if d.spark else "starts_with"
    cases = [(" or ".join(f"{key} = {d.text(a)} or {starts}({key}, {d.text(a + ' ')})" for a in aliases), d.text(name)) for name, aliases in v.FAMILIES.items()]
    return d.first_case(cases, key)


def tokens(d: Dialect, x: str) -> str:
    """Sorted distinct words of two characters or more that are no stop words."""
    found = d.all_matches(f"lower(coalesce({x}, ''))", "[a-z0-9]+")
    return d.distinct(d.kept(found, lambda w: f"length({w}) > 1 and not ({d.one_of(w, v.STOPWORDS)})"))


def uncategorised(d: Dialect, x: str) -> str:
    return d.one_of(f"lower(trim(coalesce({x}, '')))", v.UNCATEGORISED)


def spend_name(d: Dialect, x: str) -> str:
    """Short display name: UPI references and PAYTM are folded."""
    up = f"upper(trim(coalesce({x}, '')))"
    return d.first_case([(d.matches(up, r"^UPI([ /:-]|OUT|IN)"), "'UPI transfer'"), (f"contains({up}, 'PAYTM')", "'Paytm'")], f"trim({x})")
