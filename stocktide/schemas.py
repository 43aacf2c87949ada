"""Table schemas and the column lists each strictness level requires."""

from pyspark.sql import types as T

S, D = T.StringType(), T.DoubleType()


def _struct(*cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


INVENTORY = _struct(("Date", T.DateType()), ("Inventory_Level", D))
INFLOWS = _struct(
    ("Date", T.DateType()), ("Vendor", S), ("Quantity", D), ("Product_Type", S),
    ("Category", S), ("Brand", S), ("Grade", S), ("Size", S), ("Warehouse", S),
    ("Vendor_Address", S), ("GIK_Per_Unit", D), ("Total_GIK", D),
)
OUTFLOWS = _struct(
    ("Date", T.DateType()), ("Quantity", D), ("Product_Type", S), ("Category", S),
    ("Brand", S), ("Grade", S), ("Size", S), ("Warehouse", S), ("GIK_Per_Unit", D),
    ("Total_GIK", D), ("Partner", S), ("EI_Per_Unit", D), ("Total_EI", D),
    ("Partner_Address", S), ("Shipment_Type", S), ("Program", S),
)
TABLES = {"inventory": INVENTORY, "inflows": INFLOWS, "outflows": OUTFLOWS}
PERIODS = ("train", "tune", "test")

# Measures, dimensions and required columns of the data model.
NUMERIC = {
    "inventory": ["Inventory_Level"],
    "inflows": ["Quantity", "GIK_Per_Unit", "Total_GIK"],
    "outflows": ["Quantity", "GIK_Per_Unit", "Total_GIK", "EI_Per_Unit", "Total_EI"],
}
VALUE_COLUMNS = ["Total_GIK", "GIK_Per_Unit", "Total_EI", "EI_Per_Unit"]
DIMENSIONS = {
    "inventory": [],
    "inflows": ["Vendor", "Product_Type", "Category", "Brand", "Grade", "Size", "Warehouse"],
    "outflows": ["Product_Type", "Category", "Brand", "Grade", "Size", "Warehouse", "Partner"],
}
_MEDIUM_DROP = {"Vendor_Address", "EI_Per_Unit", "Total_EI", "Partner_Address", "Shipment_Type", "Program"}
REQUIRED = {
    "minimal": {
        "inventory": ["Date", "Inventory_Level"],
        "inflows": ["Date", "Quantity"],
        "outflows": ["Date", "Quantity"],
    },
    "medium": {k: [n for n in s.fieldNames() if n not in _MEDIUM_DROP] for k, s in TABLES.items()},
    "full": {k: s.fieldNames() for k, s in TABLES.items()},
}
