"""Expressions for settlements, states, cultures and religions.

Chances are decided by a number in [0, 1) that the caller gives for each row, so results are
the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a capital and a port add to a settlement's size.
CAPITAL, PORT = 1.3, 1.3
# A settlement's kind where nothing around it decides, by type of culture.
DEFAULT_KIND = {"Naval": "Coastal Village", "Highland": "Mountain Village", "Lake": "Lakeside Village", "River": "Riverside Village", "Nomadic": "Settlement", "Hunting": "Hunting Lodge"}
# What a type of culture, and a word in a settlement's kind, add to the chances of citadel, plaza and walls.
BY_CULTURE = {"Highland": (0.3, 0.0, 0.4), "Naval": (0.0, 0.2, -0.1), "River": (0.0, 0.25, 0.0), "Nomadic": (-0.2, -0.1, -0.3), "Hunting": (-0.1, 0.0, -0.2)}
BY_KIND = (("Fortress", (0.5, 0.0, 0.3)), ("Trade|Hub", (0.0, 0.3, 0.0)), ("Camp|Lodge", (-0.2, 0.0, -0.2)), ("Port", (0.0, 0.2, -0.1)))
DESERTS, FORESTS, GRASSLANDS, COLD = (11, 12), (6, 7, 8, 14, 15), (9, 13), (4, 5)


def _ladder(value: Column, steps: tuple, rest: float) -> Column:
    """The chance of the first step that the value exceeds."""
    out = F.lit(rest)
    for above, chance in reversed(steps):
        out = F.when(value > above, chance).otherwise(out)
    return out


def _unit(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def population(suitability: Column, ident: Column, cell: Column, capital: Column, port: Column, noise: Column) -> Column:
    """Thousands of people; small terms of id and cell part equals."""
    base = F.greatest(suitability / 8 + ident / 1000 + (cell % 100) / 1000, F.lit(0.1))
    return F.round(base * F.when(capital, CAPITAL).otherwise(1.0) * F.when(port, PORT).otherwise(1.0) * noise, 3)


def kind(port: Column, lake: Column, height: Column, flux: Column, coast: Column, biome: Column, culture: Column, people: Column) -> Column:
    """What a settlement is: by its port, shore, height, river, coast, biome, in this order, and else by its culture."""
    is_ = lambda c: culture == c
    out = F.lit("Village")
    for c, k in DEFAULT_KIND.items():
        out = F.when(is_(c), k).otherwise(out)
    return (
        F.when(port, "Port")
        .when(lake, "Lake")
        .when(height > 60, F.when(is_("Highland"), "Highland Fortress").otherwise("Highland"))
        .when(flux >= 100, F.when(is_("River"), "River Trade Hub").otherwise("River"))
        .when(is_("Naval") & (coast <= 2), "Coastal")
        .when(biome.isin(*DESERTS), F.when(is_("Nomadic"), F.when(people < 20, "Oasis Camp").otherwise("Desert Town")).otherwise("Desert Outpost"))
        .when(biome.isin(*FORESTS), F.when(is_("Hunting"), F.when(people < 15, "Forest Lodge").otherwise("Woodland Settlement")).otherwise("Forest"))
        .when(biome.isin(*GRASSLANDS), F.when(is_("Nomadic"), F.when(people < 10, "Nomadic Camp").otherwise("Trading Post")).otherwise("Farming Village"))
        .when(biome.isin(*COLD), F.when(people < 20, "Northern Outpost").otherwise("Frontier Town"))
        .otherwise(out)
    )


def chances(people: Column, capital: Column, culture: Column, kind_: Column, faith: Column) -> dict[str, Column]:
    """Chances of citadel, plaza, walls and temple."""

    def extra(i: int) -> Column:
        c = F.lit(0.0)
        for name, add in BY_CULTURE.items():
            c = F.when(culture == name, add[i]).otherwise(c)
        k = F.lit(0.0)
        for words, add in reversed(BY_KIND):
            k = F.when(kind_.rlike(words), add[i]).otherwise(k)
        return c + k

    belief = F.when(~faith, -0.15).when(people > 30, 0.3).when(capital, 0.4).otherwise(0.2) + F.when(culture == "Highland", 0.1).when(culture == "Nomadic", -0.1).otherwise(0.0)
    return {
        "citadel": _unit(F.when(capital, 1.0).otherwise(_ladder(people, ((50, 0.75), (15, 0.5)), 0.1)) + extra(0)),
        "plaza": _unit(_ladder(people, ((20, 1.0), (10, 0.8), (4, 0.7)), 0.6) + extra(1)),
        "walls": _unit(F.when(capital, 1.0).otherwise(_ladder(people, ((30, 1.0), (20, 0.75), (10, 0.5)), 0.1)) + extra(2)),
        "temple": _unit(_ladder(people, ((50, 0.95), (35, 0.75), (20, 0.5), (10, 0.25)), 0.1) + belief, 0.05, 0.95),
    }


def shanty_chance(people: Column, walls: Column, culture: Column) -> Column:
    base = F.when(people > 60, 1.0).when(people > 40, 0.75).when((people > 20) & walls, 0.4).otherwise(0.0)
    return _unit(base - F.when(culture.isin("Nomadic", "Hunting"), 0.3).otherwise(0.0))


def port_position(x: Column, y: Column, hx: Column, hy: Column, share: float = 0.67) -> tuple[Column, Column]:
    """Moved towards the haven; where it stands without one."""
    move = lambda a, b: F.round(F.coalesce(a + (b - a) * share, a), 2)
    return move(x, hx), move(y, hy)


def culture_cost(people: Column, height: Column, distance: Column) -> Column:
    """Of moving into a cell: less where people can live, more on hills and far from the centre; never below 0."""
    cost = F.when(people > 0, -F.least(people * 5, F.lit(30.0))).otherwise(20.0) + F.when(height > 70, 50).when(height > 50, 10).otherwise(0) + distance / 50
    return F.greatest(cost, F.lit(0.0))


# What a state's type multiplies or adds.  Of another culture; of land where nobody can live; of
# distance, as a divisor; of water; of heights, from the least height on and below all; on a coast, next to it, inland.
FOREIGN = {"Naval": 70.0, "Highland": 130.0}
BARREN = {"Nomadic": 3000.0, "Highland": 4000.0}
REACH = {"Nomadic": 100.0, "Highland": 30.0, "Naval": 80.0}
WATER = {"Naval": 150, "River": 800, "Lake": 600, "Highland": 2000, "Nomadic": 10000}
HEIGHTS = {
    "Highland": ((80, 0), (62, 50), (40, 200), (0, 800)),
    "Naval": ((80, 1500), (62, 800), (40, 200), (0, 0)),
    "River": ((80, 1200), (62, 600), (40, 100), (30, 0), (0, 300)),
    "Nomadic": ((80, 1800), (62, 900), (40, 300), (0, 0)),
    "Lake": ((80, 1000), (62, 400), (40, 100), (0, 50)),
    "Generic": ((80, 1200), (62, 600), (44, 200), (0, 0)),
}
SHORES = {"Naval": (0, 30, 100), "Lake": (0, 0, 100), "Nomadic": (60, 30, 0), "Generic": (20, 0, 0)}
SEA_CROSSING, OTHER_CULTURE, OTHER_BARREN, OTHER_REACH = 1000, 100.0, 5000.0, 50.0


def _by_type(type_: Column, values: dict, rest, f=lambda v: v) -> Column:
    out = None
    for name, v in values.items():
        if name != "Generic":
            out = F.when(type_ == name, f(v)) if out is None else out.when(type_ == name, f(v))
    return out.otherwise(f(rest))


def state_cost(same_culture: Column, height: Column, suitability: Column, movement: Column, same_biome: Column, type_: Column, on_river: Column, flux: Column, coast: Column, distance: Column) -> Column:
    """Of expanding a state into a cell, by the state's type: culture, people, biome, height, river, shore and the way from its centre; at least 0.

    coast is the distance field; distance that from the centre; flux counts on rivers alone.
    """
    is_ = lambda *t: type_.isin(*t)
    wet = height < 20
    culture = F.when(same_culture, F.when(is_("Highland", "Nomadic"), -13.5).otherwise(-9.0)).otherwise(_by_type(type_, FOREIGN, OTHER_CULTURE))
    people = F.greatest(20 - suitability, F.lit(0)) * F.when(is_("River") & on_river, 0.5).otherwise(1.0)
    land = F.when(wet, F.when(is_("Naval"), 0.0).otherwise(200.0)).when(suitability > 0, people).otherwise(_by_type(type_, BARREN, OTHER_BARREN))
    biome = F.when(same_biome, 5).when(is_("Nomadic"), movement * 2).otherwise(movement)

    def ladder(steps):
        out = F.when(height >= steps[0][0], steps[0][1])
        for least, cost in steps[1:]:
            out = out.when(height >= least, cost)
        return out

    climb = F.when(wet, _by_type(type_, WATER, SEA_CROSSING)).otherwise(_by_type(type_, HEIGHTS, HEIGHTS["Generic"], ladder))
    river = F.when(on_river & ~is_("River"), F.least(F.greatest(F.floor(flux / 10), F.lit(20)), F.lit(100))).otherwise(0)
    shore = F.when(coast <= 0, 0).otherwise(_by_type(type_, SHORES, SHORES["Generic"], lambda v: F.when(coast == 1, v[0]).when(coast == 2, v[1]).otherwise(v[2])))
    return F.greatest(culture + land + biome + climb + river + shore + distance / _by_type(type_, REACH, OTHER_REACH), F.lit(0.0))


def name_base(type_: Column, x: Column, y: Column, width: float, height: float, bases: int) -> Column:
    """Which list of names a culture uses: by the quadrant of its centre and its type."""
    quadrant = (x > width / 2).cast("int") + 2 * (y > height / 2).cast("int")
    shift = F.when(type_ == "Naval", 1).when(type_ == "Nomadic", 2).when(type_ == "Highland", 3).otherwise(0)
    return (quadrant * 4 + shift) % bases


# The patterns of a deity's meaning and their weights.
DEITY_PATTERNS = (
    ("Number", 1), ("Being", 3), ("Adjective", 5), ("Color + Animal", 5), ("Adjective + Animal", 5), ("Adjective + Being", 5), ("Adjective + Genitive", 1),
    ("Color + Being", 3), ("Color + Genitive", 3), ("Being + of + Genitive", 2), ("Being + of the + Genitive", 1), ("Animal + of + Genitive", 1),
    ("Adjective + Being + of + Genitive", 2), ("Adjective + Animal + of + Genitive", 2),
)


def deity(ident: Column, words: dict[str, tuple]) -> Column:
    """A deity's meaning by one of the weighted patterns; pattern and words (by part of the pattern) are picked by the id."""
    pick = lambda kind, salt: F.element_at(F.array(*[F.lit(w) for w in words[kind]]), ((ident * 7 + salt) % len(words[kind]) + 1).cast("int"))
    at, upto, out = ident * 13 % sum(w for _, w in DEITY_PATTERNS), 0, None
    for pattern, weight in DEITY_PATTERNS:
        text = F.concat_ws(" ", *[pick(part, salt) if part in words else F.lit(part) for salt, part in enumerate(pattern.split(" + "))])
        upto += weight
        out = F.when(at < upto, text) if out is None else out.when(at < upto, text)
    return out


def religion_cost(same_culture: Column, scope: Column, height: Column) -> Column:
    """Of spreading a religion into a cell from its neighbour; null where its scope or water bars the way."""
    cost = 1.0 + F.when(same_culture, -9.0).otherwise(10.0) + F.when(~same_culture & (scope != "state"), 10.0).otherwise(0.0)
    return F.when(height >= 20, F.greatest(cost, F.lit(0.1)))


def folk_religion(culture: Column, form: Column) -> tuple[Column, Column]:
    """Name and code of a culture's folk religion: the form's word after the culture's name, and two letters of each."""
    word = F.when(form == "Shamanism", "Spirits").when(form == "Animism", "Ways").when(form == "Ancestor worship", "Ancestors").otherwise("Beliefs")
    return F.concat_ws(" ", culture, word), F.upper(F.concat(F.substring(culture, 1, 2), F.substring(word, 1, 2)))
