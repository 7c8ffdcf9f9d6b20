"""Public suffixes: rules with wildcards and exceptions, a bundled set and any file in the format of the public suffix list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second labels under which these country codes register names.
SECOND = {
    "ac co gov ltd me net nhs org plc police sch": "uk",
    "asn com edu gov id net org": "au",
    "ac ad co ed go gr lg ne or": "jp",
    "ac co geek gen govt iwi maori net org school": "nz",
    "ac com edu gov mil net org": "cn tw hk sg my tr mx ar br ua pe ve ec eg sa pk ph vn co pl",
    "ac co edu firm gen gov ind net org res": "in",
    "ac co go ne or re": "kr",
    "ac co gov net org web": "za",
    "ac co go in mi net or": "th",
    "ac co go net or sch web": "id",
    "ac co gov muni net org": "il",
}
#: Other suffixes, those of hosts that give names to their users among them.
MORE = "github.io gitlab.io herokuapp.com blogspot.com vercel.app netlify.app pages.dev workers.dev web.app firebaseapp.com appspot.com azurewebsites.net cloudfront.net s3.amazonaws.com fly.dev onrender.com surge.sh readthedocs.io wordpress.com"
WILD = "ck er fk kh mm np bd kawasaki.jp kitakyushu.jp kobe.jp nagoya.jp sapporo.jp sendai.jp yokohama.jp compute.amazonaws.com"
NOT = "www.ck city.kawasaki.jp city.kitakyushu.jp city.kobe.jp city.nagoya.jp city.sapporo.jp city.sendai.jp city.yokohama.jp"


@dataclass(frozen=True)
class Rules:
    plain: frozenset[str]
    wild: frozenset[str]
    exceptions: frozenset[str]

    @classmethod
    def of(cls, lines) -> Rules:
        """From lines like co.uk, *.ck and !www.ck; comments begin with //."""
        rules = [x.split()[0].lower() for x in lines if x.strip() and not x.lstrip().startswith("//")]
        return cls(frozenset(x for x in rules if x[0] not in "*!"), frozenset(x[2:] for x in rules if x.startswith("*.")), frozenset(x[1:] for x in rules if x[0] == "!"))


def bundled() -> Rules:
    two = [f"{s}.{c}" for labels, codes in SECOND.items() for s in labels.split() for c in codes.split()]
    return Rules.of([*two, *MORE.split(), *(f"*.{x}" for x in WILD.split()), *(f"!{x}" for x in NOT.split())])


def read(path: str) -> Rules:
    with open(path, encoding="utf-8") as f:
        return Rules.of(f)


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def registrable(name: Column, rules: Rules | None = None) -> Column:
    """The longest public suffix of a host and one label more. Addresses, single labels and suffixes stand for themselves; a last label without a rule is a suffix."""
    rules = rules or bundled()
    most = max((x.count(".") + 2 for x in rules.plain | rules.wild), default=2)

    def of(labels: Column) -> Column:
        last = lambda n: F.array_join(F.slice(labels, F.lit(-n), F.lit(n)), ".")
        among = lambda x, names: F.contains(F.lit(f" {' '.join(sorted(names))} "), F.concat(F.lit(" "), x, F.lit(" ")))  # noqa: E731  one literal, however many names
        size = F.lit(1)
        for n in range(1, most + 1):
            hit = F.lit(False)
            if own := [x for x in rules.plain if x.count(".") == n - 1]:
                hit = hit | among(last(n), own)
            if own := [x for x in rules.wild if x.count(".") == n - 2]:
                hit = hit | among(last(n - 1), own)
            size = F.when((F.size(labels) >= n) & hit, F.lit(n)).otherwise(size)
        for n in sorted({x.count(".") + 1 for x in rules.exceptions}):
            size = F.when((F.size(labels) >= n) & among(last(n), [x for x in rules.exceptions if x.count(".") == n - 1]), F.lit(n - 1)).otherwise(size)
        return let(size, lambda k: F.array_join(F.when(F.size(labels) > k, F.slice(labels, -(k + 1), k + 1)).otherwise(labels), "."))

    whole = F.lower(name)
    return F.when(name.rlike(r"^[\d.]+$") | name.startswith("[") | ~name.contains("."), whole).otherwise(let(F.split(whole, r"\."), of))
