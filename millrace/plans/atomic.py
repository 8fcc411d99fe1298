"""The fixed columns of an event row."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, types and order of the event format's columns (fixed values).
_COLUMNS = """
app_id string
platform string
etl_tstamp timestamp
collector_tstamp timestamp required
dvce_created_tstamp timestamp
event string
event_id string required
txn_id int
name_tracker string
v_tracker string
v_collector string required
v_etl string required
user_id string
user_ipaddress string
user_fingerprint string
domain_userid string
domain_sessionidx int
network_userid string
geo_country string
geo_region string
geo_city string
geo_zipcode string
geo_latitude double
geo_longitude double
geo_region_name string
ip_isp string
ip_organization string
ip_domain string
ip_netspeed string
page_url string
page_title string
page_referrer string
page_urlscheme string
page_urlhost string
page_urlport int
page_urlpath string
page_urlquery string
page_urlfragment string
refr_urlscheme string
refr_urlhost string
refr_urlport int
refr_urlpath string
refr_urlquery string
refr_urlfragment string
refr_medium string
refr_source string
refr_term string
mkt_medium string
mkt_source string
mkt_term string
mkt_content string
mkt_campaign string
se_category string
se_action string
se_label string
se_property string
se_value double
tr_orderid string
tr_affiliation string
tr_total decimal(18,2)
tr_tax decimal(18,2)
tr_shipping decimal(18,2)
tr_city string
tr_state string
tr_country string
ti_orderid string
ti_sku string
ti_name string
ti_category string
ti_price decimal(18,2)
ti_quantity int
pp_xoffset_min int
pp_xoffset_max int
pp_yoffset_min int
pp_yoffset_max int
useragent string
br_name string
br_family string
br_version string
br_type string
br_renderengine string
br_lang string
br_features_pdf boolean
br_features_flash boolean
br_features_java boolean
br_features_director boolean
br_features_quicktime boolean
br_features_realplayer boolean
br_features_windowsmedia boolean
br_features_gears boolean
br_features_silverlight boolean
br_cookies boolean
br_colordepth string
br_viewwidth int
br_viewheight int
os_name string
os_family string
os_manufacturer string
os_timezone string
dvce_type string
dvce_ismobile boolean
dvce_screenwidth int
dvce_screenheight int
doc_charset string
doc_width int
doc_height int
tr_currency string
tr_total_base decimal(18,2)
tr_tax_base decimal(18,2)
tr_shipping_base decimal(18,2)
ti_currency string
ti_price_base decimal(18,2)
base_currency string
geo_timezone string
mkt_clickid string
mkt_network string
etl_tags string
dvce_sent_tstamp timestamp
refr_domain_userid string
refr_dvce_tstamp timestamp
domain_sessionid string
derived_tstamp timestamp
event_vendor string
event_name string
event_format string
event_version string
event_fingerprint string
true_tstamp timestamp
"""


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "decimal(18,2)": T.DecimalType(18, 2)}


def atomic_fields(load_tstamp: bool = False) -> list[T.StructField]:
    """The 128 columns in order, and ``load_tstamp`` where a loader adds it."""
    lines = _COLUMNS.split("\n") + (["load_tstamp timestamp required"] if load_tstamp else [])
    parts = [line.split() for line in lines if line]
    return [T.StructField(p[0], _TYPES[p[1]], len(p) == 2) for p in parts]


def money_fields() -> list[str]:
    return [f.name for f in atomic_fields() if isinstance(f.dataType, T.DecimalType)]
