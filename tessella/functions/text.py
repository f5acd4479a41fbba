"""Scalar text functions: normal forms, match keys and notations, as Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta",
    "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho",
    "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
SALTS = (
    "hydrochloride", "hcl", "mesylate", "mesilate", "tosylate", "sulfate", "sulphate", "phosphate", "tartrate",
    "acetate", "maleate", "fumarate", "citrate", "succinate", "gluconate", "malate", "besylate", "bromide",
    "chloride", "sodium", "potassium", "calcium", "magnesium", "zinc", "lysinate", "lysine",
)
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9"}
AMINO = {
    "A": "ala", "R": "arg", "N": "asn", "D": "asp", "C": "cys", "Q": "gln", "E": "glu", "G": "gly", "H": "his",
    "I": "ile", "L": "leu", "K": "lys", "M": "met", "F": "phe", "P": "pro", "S": "ser", "T": "thr", "W": "trp",
    "Y": "tyr", "V": "val", "*": "ter", "X": "ter",
}
UNSAFE_PLURALS = ("ss", "us", "is", "os")


def tidy(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def safe_normalise(c: Column) -> Column:
    """Dashes to hyphens, possessive endings off, trimmed, lower case; empty becomes null."""
    s = F.regexp_replace(F.translate(c, "–—", "--"), "['‘’ʼ]s($|[^A-Za-z0-9_])", "$1")
    return F.nullif(F.lower(F.trim(s)), F.lit(""))


def match_key(c: Column) -> Column:
    """Words of the normal form in sorted order, so that word order and punctuation don't matter."""
    words = F.split(F.trim(F.regexp_replace(safe_normalise(c), "[^a-z0-9]+", " ")), " ")
    return F.nullif(F.array_join(F.array_sort(words), " "), F.lit(""))


def spell_greek(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), GREEK.items(), c)


def without_salt(c: Column) -> Column:
    """The base name of a salt, null if the name is none."""
    name = F.regexp_replace(F.trim(c), r"\s+", " ")
    salt = rf"(?i)^(.*\S) ({'|'.join(SALTS)})$"
    return F.when(name.rlike(salt), F.regexp_extract(name, salt, 1))


def plural_variant(c: Column) -> Column:
    """The singular of a safe plural, the plural of what ends in a letter, else null."""
    ends_s = c.endswith("s")
    unsafe = reduce(lambda a, b: a | b, (c.endswith(e) for e in UNSAFE_PLURALS))
    drop = F.substring(c, F.lit(1), F.length(c) - 1)
    return F.when(ends_s & (F.length(c) > 3) & ~unsafe, drop).when(~ends_s & c.rlike(r"\p{L}$"), F.concat(c, F.lit("s")))


def roman_types(c: Column) -> Column:
    """'type IV' to 'type 4', I to IX, in any case."""
    longest = sorted(ROMAN, key=len, reverse=True)
    return reduce(lambda x, r: F.regexp_replace(x, rf"(?i)\b(type)\s+{r}\b", f"$1 {ROMAN[r]}"), longest, c)


def without_bases(c: Column) -> Column:
    """Trailing bases after dup, del or ins taken off."""
    return F.regexp_replace(c, r"(?i)(dup|del|ins)[acgt]+$", "$1")


def amino_name(c: Column) -> Column:
    """Three-letter code of a one-letter residue."""
    pairs = [F.lit(x) for kv in AMINO.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.upper(c))


def shorthand_pattern(c: Column) -> Column:
    """A pattern for a protein change written short (V600E, p.C634), null for other shapes."""
    shape = r"(?i)^(?:p\.)?([ARNDCQEGHILKMFPSTWYV])(\d+)([ARNDCQEGHILKMFPSTWYVX*]?)$"
    s = F.trim(c)
    a, n, b = (F.regexp_extract(s, shape, i) for i in (1, 2, 3))
    return F.when(s.rlike(shape), F.concat(amino_name(a), n, F.when(b == "", F.lit("[a-z]{3}")).otherwise(amino_name(b))))


def acronym(c: Column) -> Column:
    """First letters of the words that begin with a letter."""
    words = F.filter(F.split(c, " "), lambda w: w.rlike("^[A-Za-z]"))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def camel_words(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def is_structural(c: Column) -> Column:
    """Whether a name is an identifier of a structure rather than a name: InChI, SMILES-like, registry number."""
    return c.rlike(r"^InChI=|^[A-Z]{14}-[A-Z]{10}-[A-Z]$|^\d{2,7}-\d{2}-\d$|[=#@\\/]{1}.*[()\[\]]")


def packed_length(c: Column, by: str = "|") -> Column:
    """How many entries a packed cell has; null and empty have none."""
    return F.when(c.isNull() | (c == ""), 0).otherwise(F.size(F.split(c, "\\" + by))).cast("int")


def phase_ordinal(c: Column) -> Column:
    """Approved or marketed 5, else the largest number in it, a stage without number 0, missing -1."""
    s = F.upper(F.trim(c))
    numbers = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    missing = s.isNull() | s.isin("", "NONE", "NAN")
    return F.when(missing, -1).when(s.contains("APPROV") | s.contains("MARKET"), 5).otherwise(F.coalesce(F.array_max(numbers), F.lit(0))).cast("int")


def row_text(*names: str, most: int = 10) -> Column:
    """'name: value | …' of the first `most` values that aren't null."""
    parts = F.filter(F.array(*[F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in names]), lambda x: x.isNotNull())
    return F.array_join(F.slice(parts, 1, most), " | ")


def number(c: Column) -> Column:
    """A double, null where it is none."""
    return c.try_cast("double")


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))
