"""Column vocabulary, pinned source schemas and the registry of pass tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The action types that get their own columns, top of funnel first.
FUNNEL_ACTIONS = (
    "link_click",
    "landing_page_view",
    "view_content",
    "search",
    "add_to_cart",
    "initiate_checkout",
    "purchase",
    "complete_registration",
    "lead",
    "video_view",
    "post_engagement",
    "comment",
)

# Delivery metrics, always stored as doubles.
DELIVERY_METRICS = ("impressions", "clicks", "spend", "reach", "frequency", "cpm", "cpc", "ctr")

ENTITY_COLUMNS = ("campaign_id", "campaign_name", "adset_id", "adset_name", "ad_id", "ad_name")

# The measures carried by every fact table of the star schema.
FACT_METRICS = (
    "impressions",
    "reach",
    "clicks",
    "spend",
    "link_click",
    "landing_page_view",
    "view_content",
    "add_to_cart",
    "initiate_checkout",
    "purchase",
    "purchase_value",
    "video_view",
    "post_engagement",
)

HOUR_RANGE = "hourly_stats_aggregated_by_advertiser_time_zone"


@dataclass(frozen=True)
class PassSpec:
    """One extraction shape: an entity level plus optional breakdown columns."""

    name: str
    view: str
    level: str = "ad"
    breakdowns: tuple[str, ...] = ()


PASSES = {
    p.name: p
    for p in (
        PassSpec("base", "ads_daily"),
        PassSpec("age_gender", "ads_by_age_gender", breakdowns=("age", "gender")),
        PassSpec(
            "placement",
            "ads_by_placement",
            breakdowns=("publisher_platform", "platform_position", "impression_device"),
        ),
        PassSpec("region", "ads_by_region", breakdowns=("region",)),
        PassSpec("hourly", "campaigns_by_hour", level="campaign", breakdowns=(HOUR_RANGE,)),
    )
}

ALL_BREAKDOWNS = tuple(b for p in PASSES.values() for b in p.breakdowns)

_ACTION_LIST = T.ArrayType(
    T.StructType([T.StructField("action_type", T.StringType()), T.StructField("value", T.StringType())])
)


def insight_schema(breakdowns=ALL_BREAKDOWNS) -> T.StructType:
    """Source row as landed: every scalar is text, actions are nested arrays."""
    scalars = (*ENTITY_COLUMNS, "date_start", *DELIVERY_METRICS, *breakdowns)
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in scalars]
        + [T.StructField("actions", _ACTION_LIST), T.StructField("action_values", _ACTION_LIST)]
    )


def pass_schema(spec: PassSpec) -> T.StructType:
    """Tidy table of one pass, without its partition columns."""
    fields = [T.StructField("pass_name", T.StringType()), T.StructField("date", T.DateType())]
    fields += [T.StructField(c, T.StringType()) for c in ENTITY_COLUMNS]
    fields += [T.StructField(c, T.DoubleType()) for c in DELIVERY_METRICS]
    for action in FUNNEL_ACTIONS:
        fields += [
            T.StructField(action, T.LongType()),
            T.StructField(f"{action}_value", T.DoubleType()),
        ]
    fields += [T.StructField(c, T.StringType()) for c in spec.breakdowns]
    return T.StructType(fields + [T.StructField("actions_raw", T.StringType())])


_CREATIVE_FIELDS = (
    "id",
    "name",
    "title",
    "body",
    "image_url",
    "thumbnail_url",
    "object_type",
    "call_to_action_type",
    "video_id",
    "effective_object_story_id",
)

CREATIVE_SOURCE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "name", "status", "created_time")]
    + [
        T.StructField(
            "creative", T.StructType([T.StructField(c, T.StringType()) for c in _CREATIVE_FIELDS])
        )
    ]
)
