"""Silver fact and gold tables from the star-schema sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions.cleaning import (
    clean_text,
    decimal_number,
    first_filled,
    first_number,
    label_text,
    month_period,
    parse_timestamp,
    positive_flag,
    segment_middle,
)
from gridpulse.operators.aggregates import circuit_summary, daily_attribution, daily_impact, environment_daily, event_rollup
from gridpulse.operators.filters import lon_lat_share
from gridpulse.operators.joins import Dimension, star_join
from gridpulse.operators.reshape import filter_index, point_layer
from gridpulse.sources.readers import with_columns_present
from gridpulse.sources.writers import write_table


@dataclass(frozen=True)
class StarSources:
    """The eight source tables, all text, with the column names of the source files."""

    fact: DataFrame
    events: DataFrame
    spans: DataFrame
    equipment: DataFrame
    supports: DataFrame
    causes: DataFrame
    transformers: DataFrame
    weather: DataFrame
    weather_columns: Sequence[str] = field(default_factory=tuple)


_PLACE = {"municipio": "string", "municipio_source": "string", "municipio_confidence": "string"}


def _typed(src: StarSources) -> Mapping[str, DataFrame]:
    events = src.events.select(
        clean_text("event_id").alias("event_id"),
        parse_timestamp("FECHA").alias("event_ts"),
        decimal_number("DURACION").alias("duration"),
        decimal_number("UITI").alias("event_impact"),
        decimal_number("TOT_USUS").alias("event_users"),
        decimal_number("CNT_TRF").alias("transformer_count"),
        clean_text("COD_CAUSA").alias("cause_code"),
        clean_text("COD_EQ_PROTEGE").alias("protecting_code"),
    ).withColumn("day", F.to_date("event_ts"))
    spans = with_columns_present(src.spans, _PLACE).select(
        clean_text("FID_VANO").alias("span_id"),
        clean_text("FID_SW").alias("switch_id"),
        clean_text("FID_APOYO_FIN").alias("support_id"),
        clean_text("municipio").alias("span_municipality"),
        clean_text("municipio_source").alias("span_municipality_source"),
        clean_text("municipio_confidence").alias("span_municipality_confidence"),
        decimal_number("X1").alias("longitude"),
        decimal_number("Y1").alias("latitude"),
        decimal_number("X2").alias("longitude_end"),
        decimal_number("Y2").alias("latitude_end"),
        decimal_number("LONGITUD").alias("span_length"),
        clean_text("CONDUCTOR").alias("conductor"),
        clean_text("TIPO_TAX").alias("span_type"),
    )
    equipment = src.equipment.select(
        clean_text("FID_SW").alias("switch_id"),
        clean_text("CIRCUITO").alias("circuit_raw"),
        clean_text("TIPO").alias("switch_type"),
        decimal_number("T_USUS_EQ_PROT").alias("protected_users"),
        decimal_number("CNT_VN_SW").alias("protected_spans"),
    )
    supports = src.supports.withColumn("support_id", clean_text("FID_APOYO_FIN")).drop("FID_APOYO_FIN")
    causes = src.causes.select(
        clean_text("COD_CAUSA").alias("cause_code"), first_filled("DESC_CAUSA", default="Sin causa").alias("cause_text")
    )
    transformers = with_columns_present(src.transformers, _PLACE).select(
        clean_text("trafo_profile_id").alias("profile_id"),
        clean_text("municipio").alias("transformer_municipality"),
        clean_text("municipio_source").alias("transformer_municipality_source"),
        clean_text("municipio_confidence").alias("transformer_municipality_confidence"),
        decimal_number("CNT_USUS").alias("transformer_users"),
        decimal_number("CAPACIDAD_NOMINAL").alias("transformer_capacity"),
    )
    weather = src.weather.select(
        clean_text("FID_VANO").alias("span_id"), parse_timestamp("FECHA").alias("weather_ts"), *src.weather_columns
    )
    return dict(
        events=events, spans=spans, equipment=equipment, supports=supports, causes=causes, transformers=transformers, weather=weather
    )


def silver_fact(src: StarSources) -> DataFrame:
    """Fact expanded with every dimension, with the business defaults applied."""
    t = _typed(src)
    fact = src.fact.select(
        F.col("row_id").cast("long").alias("row_id"),
        clean_text("event_id").alias("event_id"),
        clean_text("FID_VANO").alias("span_id"),
        clean_text("trafo_profile_id").alias("profile_id"),
        decimal_number("UITI_VANO").alias("span_impact"),
    )
    taken = set(fact.columns).union(*[t[name].columns for name in t if name != "weather"])
    readings = [c for c in t["weather"].columns if c not in taken]
    wide = star_join(
        fact,
        [
            Dimension(t["events"], {"event_id": "event_id"}),
            # the readings come before the wide dimensions, whose columns would be shuffled by span and time as well
            Dimension(t["weather"], {"span_id": "span_id", "event_ts": "weather_ts"}, readings),
            Dimension(t["spans"], {"span_id": "span_id"}),
            Dimension(t["equipment"], {"switch_id": "switch_id"}),
            Dimension(t["supports"], {"support_id": "support_id"}),
            Dimension(t["causes"], {"cause_code": "cause_code"}),
            Dimension(t["transformers"], {"profile_id": "profile_id"}),
        ],
    )
    # columns in the order of the dimensions
    wide = wide.select(*[c for c in wide.columns if c not in readings], *readings)
    return wide.withColumns(
        {
            "cause": F.col("cause_text"),
            "circuit": first_filled("circuit_raw", default="Sin circuito"),
            "municipality": first_filled("span_municipality", "transformer_municipality", default="Sin municipio"),
            "municipality_source": first_filled("span_municipality_source", "transformer_municipality_source"),
            "municipality_confidence": first_filled(
                "span_municipality_confidence", "transformer_municipality_confidence", default="unresolved"
            ),
            "event_family": F.lit("Eventos Vano"),
            "criteria_group": F.lit("Eventos Vano"),
            "equipment": first_filled("switch_id", "protecting_code", default="Sin equipo"),
            "equipment_type": first_filled("switch_type", default="Proteccion"),
            "element_type": first_filled("span_type", default="Vano"),
            "users": first_number("transformer_users", "event_users"),
            "impact_flag": positive_flag("span_impact"),
        }
    )


def span_assets(src: StarSources, map_day: str) -> DataFrame:
    """One line asset per span; ``map_day`` is the day the layer is stamped with."""
    t = _typed(src)
    stamped = F.lit(map_day).cast("date")
    return star_join(t["spans"], [Dimension(t["equipment"], {"switch_id": "switch_id"}, ["circuit_raw"])]).select(
        "*",
        F.lit("LineSegments").alias("asset_family"),
        F.coalesce("span_id", F.lit("Vano")).alias("display_label"),
        first_filled("circuit_raw", default="Sin circuito").alias("circuit"),
        first_filled("span_municipality", default="Sin municipio").alias("municipality"),
        F.lit("line").alias("geometry_kind"),
        stamped.alias("map_date"),
        month_period(stamped).alias("period"),
        F.dayofmonth(stamped).alias("map_day"),
        label_text(F.coalesce("span_id", F.lit("Vano")), first_filled("circuit_raw", default="Sin circuito"), "conductor", "span_length").alias(
            "popup_text"
        ),
    )


def map_tables(fact: DataFrame, assets: DataFrame, distinct_switches: bool = False, least_valid: float = 0.95) -> dict[str, DataFrame]:
    """Point, segment and filter-index tables; all empty unless ``least_valid`` of the spans have valid coordinates."""
    ok = lon_lat_share(assets, ["longitude", "longitude_end"], ["latitude", "latitude_end"], least_valid).first()["lon_lat_ok"]
    gate = F.lit(bool(ok))
    events = fact.select(
        F.lit("Eventos Vano").alias("asset_family"),
        label_text("event_id", "cause", "span_id").alias("display_label"),
        F.col("span_id").alias("code"),
        "equipment",
        "circuit",
        "municipality",
        month_period("day").alias("period"),
        F.dayofmonth("day").alias("map_day"),
        "latitude",
        "longitude",
        F.lit("point").alias("geometry_kind"),
        label_text("event_id", "circuit", "cause", "span_impact").alias("popup_text"),
    )
    switches = assets.select(
        F.lit("Switches").alias("asset_family"),
        "display_label",
        F.col("switch_id").alias("code"),
        F.col("switch_id").alias("equipment"),
        "circuit",
        "municipality",
        "period",
        "map_day",
        segment_middle("latitude", "latitude_end").alias("latitude"),
        segment_middle("longitude", "longitude_end").alias("longitude"),
        "geometry_kind",
        label_text("switch_id", "circuit", "display_label").alias("popup_text"),
    )
    if distinct_switches:
        switches = switches.groupBy("code").agg(*[F.min(c).alias(c) for c in switches.columns if c != "code"])
    points = point_layer(events, switches).where(gate)
    segments = assets.where(gate).dropna(how="any", subset=["latitude", "longitude", "latitude_end", "longitude_end"])
    return {"map_points": points, "map_segments": segments, "map_filter_index": filter_index([points, segments])}


def gold_tables(fact: DataFrame, weather: DataFrame | None = None, weather_columns: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Gold roll-ups over the silver fact. Write the silver fact first and pass the stored table in."""
    events = event_rollup(fact)
    out = {
        "silver_events": events,
        "impact_daily": daily_impact(events),
        "impact_circuit_summary": circuit_summary(events),
        "daily_attribution": daily_attribution(fact),
        "probability_inputs": fact.withColumns(
            {"source_date": F.col("day"), "target_flag": positive_flag("span_impact"), "event_count": F.lit(1.0)}
        ),
    }
    if weather is not None:
        out["environment_daily"] = environment_daily(weather, ["day", "municipality"], weather_columns).withColumn(
            "environment_family", F.lit("Clima")
        )
    return out


def store_gold(tables: Mapping[str, DataFrame], folder: str, spread: int = 8) -> None:
    """Write gold tables below ``folder``; those with a ``day`` are partitioned by its month.

    Rows of a month go to ``spread`` files by day, so that a busy month is written by several tasks.
    """
    for name, frame in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        if "day" not in frame.columns:
            write_table(frame, path)
            continue
        dated = frame.withColumn("month", F.trunc("day", "MM"))
        write_table(dated.repartition("month", F.pmod(F.xxhash64("day"), F.lit(spread))), path, partition_by=["month"])


def load_gold(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Stored gold tables; ``month`` filters, which ``in_window`` adds, prune their folders."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}
