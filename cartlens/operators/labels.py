"""Names for devices, payment apps, libraries and models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import first_match

# Library and model codes. Code 2 is a vendor's own name and a model can
# carry a merchant's: callers that need them add them to the mapping.
LIBRARIES = {1: "CHECKOUTJS", 3: "S2S", 4: "CUSTOM", 5: "DIRECT", 6: "PUSH", 7: "LEGACYJS", 8: "HOSTED",
             9: "EMBEDDED"}
MODELS = {"category_5399": "Marketplace model", "category_5691": "Clothing model", "category_5977": "Cosmetics model",
          "category_infrequent_mcc_group": "Generic RTO model", "acm": "Address model", "merchant_own": "Merchant model"}

# The rules of the payment app in the order in which they are applied, as
# (payment type or any, field, how it is compared, values, app). The first match wins.
APP_RULES = [
    ("collect", "handle", "in", ["ybl", "ibl", "axl"], "Phonepe"),
    ("collect", "handle", "in", ["paytm", "pthdfc", "ptsbi", "ptaxis", "ptyes"], "Paytm"),
    ("collect", "handle", "in", ["upi"], "BHIM"),
    ("collect", "handle", "in", ["apl"], "Amazon Pay"),
    ("collect", "handle", "in", ["oksbi", "okhdfcbank", "okicici", "okaxis"], "GooglePay"),
    ("pay", "package", "in", ["com.phonepe.app"], "Phonepe"),
    ("pay", "package", "contains in any case", ["amazon"], "Amazon Pay"),
    ("pay", "package", "in", ["net.one97.paytm"], "Paytm"),
    ("pay", "package", "in", ["in.org.npci.upiapp"], "BHIM"),
    ("pay", "package", "in", ["com.google.android.apps.nbu.paisa.user"], "GooglePay"),
    ("any", "handle", "in", ["ybl", "ibl", "axl"], "Phonepe"),
    ("pay", "package", "contains", ["dreamplug"], "Cred"),
    ("any", "handle", "in", ["oksbi", "okhdfcbank", "okicici", "okaxis"], "GooglePay"),
    ("any", "handle", "in", ["Paytm", "pthdfc", "ptsbi", "ptaxis", "ptyes"], "Paytm"),
    ("any", "handle", "in", ["axisb"], "Cred"),
    ("any", "handle", "in", ["axisbank"], "Axis Bank"),
    ("any", "handle", "in", ["upi"], "BHIM"),
    ("any", "handle", "in", ["apl", "yapl", "rapl"], "Amazon Pay"),
]


def platform(kind: Column, mobile: Column) -> Column:
    """Device platform: SDK, mobile web, desktop, else NA."""
    return first_match([
        (kind == "mobile_sdk", "mobile_sdk"),
        ((kind == "browser") & (mobile == "true"), "mweb"),
        ((kind == "browser") & (mobile.isNull() | (mobile == "false")), "desktop_browser")], "NA")


def upi_app(kind: Column, handle: Column, package: Column, library: Column) -> Column:
    """Payment app from type x provider handle x package; the first rule wins."""
    kind, fields = F.lower(kind), {"handle": handle, "package": package}
    rules = []
    for of, field, how, values, app in APP_RULES:
        c = fields[field]
        hit = c.isin(values) if how == "in" else (F.lower(c) if how == "contains in any case" else c).contains(values[0])
        rules.append((hit if of == "any" else (kind == of) & hit, app))
    return first_match([*rules, ((kind == "pay") & (library != 1), "NA")], "Others")
