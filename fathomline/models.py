"""Models from outside as callables over lists, and the adapters that run them on Arrow batches.

Everything a model needs must come with the callable; it is pickled once and used for whole batches. The stand-ins are deterministic.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "struct<name:string,type:string,score:double>"
SPAN = "struct<name:string,start:int,end:int,type:string>"
RELATION = "struct<head_start:int,head_end:int,tail_start:int,tail_end:int,head_text:string,tail_text:string,relationship_type:string,confidence:double>"
NLI = "struct<entailment:double,neutral:double,contradiction:double>"

Generate = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Models:
    """``embed``: texts to vectors. ``score``: queries and texts to logits. ``generate``: prompts to replies. ``entities``: texts to lists of
    :data:`ENTITY`. ``relations``: token lists and their lists of :data:`SPAN` to lists of :data:`RELATION`. ``entail``: premises and claims
    to :data:`NLI`. Rows may be tuples or dicts."""

    embed: Callable[[list[str]], list[list[float]]]
    score: Callable[[list[str], list[str]], list[float]]
    generate: Generate
    entities: Callable[[list[str]], list[list]]
    relations: Callable[[list[list[str]], list[list]], list[list]]
    entail: Callable[[list[str], list[str]], list]


@dataclass
class Generators:
    """Generators by model id: ``configs`` says each model's ``provider``, ``providers`` make a generator of a config. One is made of each id."""

    configs: Mapping[str, dict]
    providers: Mapping[str, Callable[[dict], Generate]]
    default: str
    _made: dict[str, Generate] = field(default_factory=dict)

    def get(self, model_id: str | None = None) -> Generate:
        name = model_id or self.default
        if name not in self._made:
            if name not in self.configs:
                raise ValueError(f"no model {name!r}")
            config = {"model_id": name, **self.configs[name]}
            provider = config.setdefault("provider", next(iter(self.providers), ""))
            if provider not in self.providers:
                raise ValueError(f"no provider {provider!r} of model {name!r}")
            self._made[name] = self.providers[provider](config)
        return self._made[name]


def _fields(schema: str) -> list[str]:
    return re.findall(r"(\w+):", schema)


def _row(x, names: list[str]) -> dict:
    return dict(x) if isinstance(x, Mapping) else dict(zip(names, x, strict=True))


def generated(prompt: Column, generate: Generate) -> Column:
    """The reply to each prompt; blank prompts aren't sent, and have a blank reply."""

    @F.pandas_udf("string")
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = b.fillna("").tolist()
            asked = [t for t in texts if t.strip()]
            found = iter(generate(asked) if asked else [])
            yield pd.Series([next(found) if t.strip() else "" for t in texts], dtype="object")

    return replies(prompt)


def found_entities(text: Column, entities) -> Column:
    """An array of :data:`ENTITY` of each text; blank texts have none."""
    names = _fields(ENTITY.removeprefix("struct"))

    @F.pandas_udf(f"array<{ENTITY}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[_row(e, names) for e in es] for es in entities(b.fillna("").tolist())], dtype="object")

    return found(text)


def found_relations(tokens: Column, spans: Column, relations) -> Column:
    """An array of :data:`RELATION` of each token list with its located entities."""
    names = _fields(RELATION.removeprefix("struct"))

    @F.pandas_udf(f"array<{RELATION}>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, s in batches:
            out = relations([list(x) for x in t], [[dict(y) for y in x] for x in s])
            yield pd.Series([[_row(r, names) for r in rs] for rs in out], dtype="object")

    return found(tokens, spans)


def entailed(premise: Column, claim: Column, entail) -> Column:
    """:data:`NLI` of each pair."""
    names = _fields(NLI.removeprefix("struct"))

    @F.pandas_udf(NLI)
    def probabilities(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([_row(r, names) for r in entail(a.tolist(), b.tolist())], columns=names)

    return probabilities(premise, claim)


def overlap_score(queries: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a reranker: the share of the query's words in the text, as a logit."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        words, have = set(q.lower().split()), set(t.lower().split())
        out.append(4.0 * len(words & have) / max(1, len(words)))
    return out


def constant_embed(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedder: all texts are alike."""
    return [[1.0]] * len(texts)


def length_entail(premises: list[str], claims: list[str]) -> list[tuple[float, float, float]]:
    """A stand-in for an entailment model: premises of more characters entail more, up to a thousand; one with a length divisible by 10 contradicts."""
    return [(0.0, 0.05, 0.95) if not len(p) % 10 else (min(len(p), 1000) / 1000, 0.0, 0.0) for p in premises]


def capital_entities(texts: list[str]) -> list[list[tuple[str, str, float]]]:
    """A stand-in for an entity model: runs of two to four capitalised words are organisations."""
    return [[(n, "ORG", 0.9) for n in dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b", t))] for t in texts]


def neighbour_relations(tokens: list[list[str]], spans: list[list[dict]]) -> list[list[tuple]]:
    """A stand-in for a relation model: each located entity is related to the next one in the text."""
    out = []
    for words, located in zip(tokens, spans, strict=True):
        line = sorted(located, key=lambda s: (s["start"], s["end"]))
        text = lambda s, w=words: " ".join(w[s["start"] : s["end"] + 1])
        out.append([(a["start"], a["end"], b["start"], b["end"], text(a), text(b), "related to", 0.9) for a, b in zip(line, line[1:], strict=False)])
    return out


def scripted_reply(prompts: list[str]) -> list[str]:
    """A stand-in for a language model: prompts that ask for JSON get a profile that names their length, others a sentence that does."""
    out = []
    for p in prompts:
        if "JSON" in p:
            party = {"name": f"Party of {len(p)}", "rating": "AA", "esg_scorecard": " ", "new_director": None, "appointment_date": "2024-01-02"}
            risks = [{"name": "Risk One", "position": "chair", "relationship": "owner"}, {"name": f"party of {len(p)}"}, {"name": ""}]
            out.append("```json\n" + json.dumps({"customer": party, "corporate_guarantor": "none", "high_risk_entities": risks}) + "\n``` as asked")
        else:
            out.append(f"Here is the snapshot: The documents and the request hold {len(p)} characters. This sentence has no")
    return out


STAND_INS = Models(constant_embed, overlap_score, scripted_reply, capital_entities, neighbour_relations, length_entail)
