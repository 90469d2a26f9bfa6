"""Climate and biome expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Temperatures at equator, poles and altitude, and the tropics.
EQUATOR, POLE, TROPIC_N, TROPIC_S, GRADIENT = 25.0, -30.0, 16, -20, 0.15
EXPONENT, LAPSE = 1.5, 6.5
# Wind angles by tier from north to south, degrees of a tier.
WINDS, TIER = (225, 135, 225, 225, 135, 225), 30
# Precipitation by latitude, in bands of 5 degrees from the equator.
LATITUDE_RAIN = (4.0, 2.0, 2.0, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0, 3.0, 3.0, 2.0, 2.0, 1.0, 1.0, 1.0, 0.5)
# Band thresholds, and the biome of each temperature and precipitation band.
TEMPERATURE_BANDS, RAIN_BANDS = (-10, 5, 15, 25, 35), (20, 50, 100, 180)
BIOMES = ("Ocean", "Lake", "River", "Wetland", "Glacier", "Tundra", "Taiga", "Temperate Deciduous Forest", "Temperate Rainforest", "Temperate Grassland", "Mediterranean", "Desert", "Hot Desert", "Savanna", "Tropical Seasonal Forest", "Tropical Rainforest", "Mangrove", "Alpine")
MATRIX = (
    (4, 4, 5, 5, 5),
    (5, 5, 6, 6, 6),
    (11, 9, 7, 7, 8),
    (11, 9, 7, 7, 8),
    (12, 13, 14, 15, 15),
    (12, 12, 13, 14, 15),
)
# By biome in the order above.
HABITABILITY = (0, 20, 30, 12, 0, 4, 12, 100, 90, 30, 80, 4, 4, 22, 50, 80, 10, 10)
MOVEMENT = (10, 10, 20, 150, 5000, 1000, 200, 70, 90, 50, 60, 150, 200, 60, 70, 80, 100, 300)
COLOURS = ("#466eab", "#6ba9cb", "#4682b4", "#0b9131", "#d5e7eb", "#96784b", "#4b6b32", "#29bc56", "#409c43", "#c8d68f", "#daa520", "#b5b887", "#fbe79f", "#d2d082", "#b6d95d", "#7dcb35", "#2f4f2f", "#a0a0a0")
SEA, ALPINE, GLACIER = 20, 70, -10


def sea_level_temperature(lat: Column) -> Column:
    """Linear in the tropics, and from either tropic to its pole."""
    north, south = EQUATOR - TROPIC_N * GRADIENT, EQUATOR + TROPIC_S * GRADIENT
    return (
        F.when(lat.between(TROPIC_S, TROPIC_N), EQUATOR - F.abs(lat) * GRADIENT)
        .when(lat > 0, north - (lat - TROPIC_N) * ((north - POLE) / (90 - TROPIC_N)))
        .otherwise(south + (lat - TROPIC_S) * ((south - POLE) / (90 + TROPIC_S)))
    )


def altitude_drop(height: Column) -> Column:
    """Half-even rounding to one place; 0 on water."""
    return F.when(height < SEA, 0.0).otherwise(F.bround(F.pow((height - 18).cast("double"), F.lit(EXPONENT)) / 1000 * LAPSE, 1))


def temperature(lat: Column, height: Column) -> Column:
    """Cut off towards zero, within a signed byte."""
    t = F.least(F.greatest(sea_level_temperature(lat) - altitude_drop(height), F.lit(-128.0)), F.lit(127.0))
    return t.cast("int")


def band(value: Column, cuts: tuple) -> Column:
    """Number of thresholds at or below the value."""
    return sum((value >= c).cast("int") for c in cuts)


def pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def latitude_rain(lat: Column) -> Column:
    at = F.least(F.floor((F.abs(lat) - 1) / 5), F.lit(len(LATITUDE_RAIN) - 1))
    return pick(LATITUDE_RAIN, F.greatest(at, F.lit(0)).cast("int"))


def wind_tier(lat: Column) -> Column:
    return F.least(F.floor(F.abs(lat - 89) / TIER), F.lit(len(WINDS) - 1)).cast("int")


def wind_directions(tier: Column) -> dict[str, Column]:
    """Overlapping ranges of the angle: a wind of 135 degrees is westerly and northerly."""
    a = pick(WINDS, tier)
    return {"is_west": (a > 40) & (a < 140), "is_east": (a > 220) & (a < 320), "is_north": (a > 100) & (a < 260), "is_south": (a > 280) | (a < 80)}


def biome(height: Column, t: Column, rain: Column) -> Column:
    """Number of the biome by height, temperature and precipitation."""
    rows = F.array(*[F.array(*[F.lit(v) for v in row]) for row in MATRIX])
    cell = F.element_at(F.element_at(rows, band(t, TEMPERATURE_BANDS) + 1), band(rain, RAIN_BANDS) + 1)
    return F.when(height < SEA, 0).when(height >= ALPINE, 17).when(t <= GLACIER, 4).otherwise(cell)


def influenced_biome(b: Column, height: Column, t: Column, coast: Column, on_river: Column, by_river: Column, flux: Column, most: Column, wet_share: float = 0.8, coastal: int = 3) -> Column:
    """Coastal, river, wetland and, last and over all others, mangrove rules, in this order; coast is the distance field."""
    land = height >= SEA
    b = F.when(land & (F.abs(coast) <= coastal) & (t > 15) & (t < 25) & b.isin(9, 11), 10).otherwise(b)
    b = F.when(land & on_river, 2).when(land & by_river & (b == 11), 9).when(land & by_river & (b == 12), 13).otherwise(b)
    b = F.when(land & (b != 2) & (flux > most * wet_share), 3).otherwise(b)
    return F.when(land & (F.abs(coast) <= 1) & (t > 20), 16).otherwise(b)


def normalised(value: Column, mean: Column, most: Column) -> Column:
    return F.when(most == 0, 0.0).otherwise(F.least(F.lit(1.0), value / F.nullif(mean, F.lit(0))) * (1 - mean / F.nullif(most, F.lit(0))))


def suitability(habitability: Column, flux: Column, median: Column, most: Column, height: Column, coastal: Column, estuary: Column, haven: Column) -> Column:
    """How well a land cell feeds people; 0 where nobody can live.  haven: 'ocean', 'lake', 'fresh' or null."""
    shore = F.when(estuary, 15).otherwise(0) + F.when(haven == "fresh", 30).when(haven == "lake", 10).when(haven == "ocean", 25).otherwise(0)
    score = habitability + F.coalesce(normalised(flux, median, most) * 250, F.lit(0.0)) - (height - 50) / 5 + F.when(coastal, shore).otherwise(-5)
    return F.when((height < SEA) | (habitability == 0), 0.0).otherwise(score.cast("double"))


def plain_habitability(height: Column, t: Column, rain: Column) -> Column:
    """Habitability, 0 to 100, where no biome is known: by height, then cut for cold or heat and for drought or wet; whole at each step."""
    base = F.when(height > 80, 10).when(height > 60, 35).otherwise(80)
    by_heat = F.floor(base * F.when(t < -10, 0.2).when(t < -5, 0.4).when(t > 35, 0.3).when(t > 30, 0.6).otherwise(1.0))
    by_rain = F.floor(by_heat * F.when(rain < 5, 0.3).when(rain < 10, 0.6).when(rain > 50, 0.7).otherwise(1.0))
    return F.least(F.greatest(by_rain, F.lit(0)), F.lit(100)).cast("int")
