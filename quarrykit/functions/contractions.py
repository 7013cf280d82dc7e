"""Contraction tables and their expansion as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT = {"ain": "am", "ca": "can", "sha": "shall", "wo": "will"}


def _english() -> dict[str, str]:
    """Built from stems and endings, in the order in which alternatives are tried."""
    out: dict[str, str] = {}

    def negated(stem: str, have: bool = False) -> None:
        full = _NOT.get(stem[:-1] if stem == "can" else stem, stem[:-1] if stem.endswith("n") and stem != "can" else stem)
        said = "cannot" if stem == "can" else f"{full} not"
        key = f"{stem}'t" if stem.endswith("n") else f"{stem}n't"
        if have:
            out[f"{key}'ve"] = f"{said} have"
        out[key] = said

    def of(stem: str, **ends: str) -> None:
        for end, said in ends.items():
            out[f"{stem}'{end.replace('_', chr(39))}"] = said if " " in said else f"{stem} {said}"

    would = "would"
    negated("ain"), negated("aren"), negated("can", True)
    out["'cause"] = "because"
    of("could", ve="have")
    negated("couldn", True)
    for s in ("didn", "doesn", "don"):
        negated(s)
    negated("hadn", True)
    for s in ("hasn", "haven"):
        negated(s)
    person = lambda s, d=would: of(s, d_ve="would have", d=d, ll_ve="will have", ll="will") or out.update({f"{s}'d've": f"{s} would have", f"{s}'ll've": f"{s} will have"})
    person("he"), of("he", s="is")
    of("how", d_y="how do you", d="did", ll="will", s="is")
    person("i"), of("i", m="am", ve="have")
    negated("isn")
    person("it", "had"), of("it", s="is")
    out |= {"let's": "let us", "ma'am": "madam"}
    negated("mayn")
    of("might", ve="have"), negated("mightn", True)
    of("must", ve="have"), negated("mustn", True)
    negated("needn", True)
    out["o'clock"] = "of the clock"
    negated("oughtn", True)
    out |= {"shan't": "shall not", "shan't've": "shall not have", "sha'n't": "shall not"}
    person("she"), of("she", s="is")
    of("should", ve="have"), negated("shouldn", True)
    of("so", ve="have", s="is")
    out |= {"that'd've": "that would have"}
    of("that", d=would, s="is")
    out |= {"there'd've": "there would have"}
    of("there", d="had", s="is")
    person("they"), of("they", re="are", ve="have")
    of("to", ve="have")
    negated("wasn")
    person("we", "had"), of("we", re="are", ve="have")
    negated("weren")
    out |= {"what'll've": "what will have"}
    of("what", ll="will", re="are", s="is", ve="have")
    of("when", s="is", ve="have"), of("where", d="did", s="is", ve="have")
    out |= {"who'll've": "who will have"}
    of("who", ll="will", s="is", ve="have"), of("why", s="is", ve="have")
    of("will", ve="have")
    out |= {"won't've": "will not have", "won't": "will not"}
    of("would", ve="have"), negated("wouldn", True)
    out |= {"y'alls": "you alls", "y'all": "you all"}
    out |= {f"y'all'{e}": f"you all {said}" for e, said in (("d've", "would have"), ("d", would), ("re", "are"), ("ve", "have"))}
    person("you", "had")
    out |= {f"you'll{e}": f"you you will{said}" for e, said in (("'ve", " have"), ("", ""))}
    of("you", re="are", ve="have")
    return out


ENGLISH = _english()
DUTCH = dict(pair.split("=") for pair in "m'n=mijn;z'n=zijn;zo'n=zo een;t'is=het is;da's=dat is;di's=dit is;d'r=de haare;h'r=haar".split(";"))


def expand(text: Column, table: dict[str, str] | None = None) -> Column:
    """Lower-cased text with whole-word contractions replaced; earlier entries of the table win.

    Matches are marked, the text is split at the marks, and odd pieces are looked up in a
    map: no Python runs. Only texts that hold an apostrophe are touched further.
    """
    table = ENGLISH if table is None else table
    low = F.lower(text)
    keys = "|".join(re.escape(k) for k in table)
    marked = F.regexp_replace(low, rf"\b({keys})\b", "\x01$1\x01")
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    parts = F.transform(F.split(marked, "\x01"), lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(known, p), p)).otherwise(p))
    return F.when(low.contains("'"), F.array_join(parts, "")).otherwise(low)
