"""New entities of a batch of mentions, against resolving them one after another."""

import random

from tidemark.operators import resolve

MENTION = "mention_id bigint, name string, entity_type string, allow_snap boolean, context map<string,string>"
ENTITY = "id bigint, canonical_name string, entity_type string, attributes map<string,string>, seeded boolean"


def fold(name):
    return " ".join(w for w in name.replace("é", "e").split() if w.lower().strip(".") != "dr")


def one_by_one(mentions, entities):
    """mention_id: id of its entity; each mention sees what those before it added. Plain spellings and definite types go first."""
    known, found = [(i, n, t, s) for i, n, t, _, s in entities], {}
    for m, name, kind, snap, _ in sorted(mentions, key=lambda x: (x[2] == "other", not x[3], x[1].strip() != fold(x[1]), x[0])):
        name, forms = name.strip(), (name.strip().lower(), fold(name).lower())
        found[m] = None

        def only(form, kind=None):
            hits = [e for e in known if e[1].lower() == form and kind in (None, e[2])]
            seeded = [e for e in hits if e[3]]
            return hits[0] if len(hits) == 1 else seeded[0] if len(seeded) == 1 else None

        hits = [e for f in forms if f and (e := only(f, kind))]
        if hits or not fold(name) or kind not in resolve.CREATABLE:
            found[m] = hits[0][0] if hits and name else None
            continue
        hits = [e for f in forms if (e := only(f)) and (e[3] or "other" in (kind, e[2]))] if snap else []
        if not hits:
            hits = [(10_000 + len(known), name, kind, False)]
            known += hits
        found[m] = hits[0][0]
    return found


def test_mentions_see_each_others_new_entities(spark):
    rng, rows = random.Random(4), []
    entities = [(1, "Acme", "customer", {}, True), (2, "Board", "team", {}, True), (3, "Orbit", "other", {}, False)]
    names = ["José", "jose", "Dr. Jose", "Acme", "dr. ACME", "Board", "Orbit", "Nova", "NOVA", " nova ", "Dr.", " ", "Zed", "Dr. Zed", "zed"]
    kinds = {"nova": ["customer", "other"], "jose": ["metric", "product", "other"], "zed": ["other", "person"]}
    for i in range(300):
        name = rng.choice(names)
        rows.append((i, name, rng.choice(kinds.get(fold(name).lower(), ["customer", "other", "person"])), rng.random() < 0.7, {}))
    for name in ("jose", "nova", "zed", "Acme", "Board", "Orbit"):  # a plain spelling of each, so that one after another they find each other
        rows += [(300 + len(rows) + k, name, kind, k % 2 == 0, {}) for k, kind in enumerate(2 * kinds.get(name, ["customer", "other", "person"]))]
        rows += [(900 + len(rows) + k, name, kind, k % 2 == 1, {}) for k, kind in enumerate(2 * kinds.get(name, ["customer", "other", "person"]))]
    aliases = spark.createDataFrame([], "entity_id bigint, alias string")
    want = one_by_one(rows, entities)
    for _ in range(2):
        rng.shuffle(rows)
        got = resolve.resolve_mentions(spark.createDataFrame(rows, MENTION), spark.createDataFrame(entities, ENTITY), aliases).collect()
        assert len(got) == len(rows)
        own = {r["mention_id"]: r["entity_id"] or (r["new_name"] and (r["new_name"], r["new_type"])) for r in got}
        plain = {m: e if e is None or e < 10_000 else None for m, e in want.items()}
        assert {m: e if isinstance(e, int) else None for m, e in own.items()} == plain
        pairs = {(own[m], e) for m, e in want.items() if e and e >= 10_000}  # new entities one to one
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) >= 6 and None not in {a for a, _ in pairs}
        assert {r["outcome"] for r in got} == {"known", "snapped", "minted", "dropped"}


def test_no_mentions(spark):
    none = [spark.createDataFrame([], x) for x in (MENTION, ENTITY, "entity_id bigint, alias string")]
    assert resolve.resolve_mentions(*none).count() == 0
