"""Schemas of the domain tables, as DDL texts that readers and `createDataFrame` take."""

from __future__ import annotations

BBOX = "struct<x:double,y:double,width:double,height:double>"

PROJECTS = (
    "id long, name string, client string, location string, status string, total decimal(14,2),"
    " drawings_count int, created_at timestamp, updated_at timestamp"
)
DRAWINGS = (
    "id long, project_id long, name string, file_path string, file_size long, width_mm int,"
    " height_mm int, status string, created_at timestamp, detected_at timestamp"
)
DETECTED_OBJECTS = (
    "id long, project_id long, drawing_id long, object_type string, label string,"
    f" bbox {BBOX}, bbox_x double, bbox_y double, length_mm double, width_mm double,"
    " area_mm2 double, confidence decimal(4,3), trade string, material_hint string,"
    " quantity_estimate double, unit string, detection_model string, detection_source string,"
    " created_at timestamp"
)
BOQ_RULES = (
    "id long, key string, object_type string, trade string, category string, unit string,"
    " rate decimal(12,2), material string, keywords string, active boolean, ruleset_version string"
)
BOQ_ITEMS = (
    "id long, project_id long, drawing_id long, detected_object_id long, description string,"
    " location string, trade string, material_id long, material_name string,"
    " quantity decimal(12,3), unit string, rate decimal(12,2), total decimal(14,2), rule_id long,"
    " ruleset_version string, created_at timestamp"
)
COST_VERSIONS = (
    "id long, project_id long, version_label string, ruleset_version string,"
    " materials_total decimal(14,2), labour_total decimal(14,2), transport_total decimal(14,2),"
    " overheads_total decimal(14,2), subtotal decimal(14,2), markup_pct decimal(5,2),"
    " markup_amount decimal(14,2), contingency_pct decimal(5,2), contingency_amount decimal(14,2),"
    " total decimal(14,2), breakdown array<struct<trade:string,total:double,count:long>>,"
    " created_at timestamp"
)
MATERIALS = (
    "id long, name string, brand string, sku string, category string, unit string,"
    " rate decimal(12,2), gst_rate decimal(5,2), vendor_name string, lead_time_days int,"
    " warranty string, fire_rating string, is_preferred boolean, thumbnail_url string,"
    " active boolean, created_at timestamp"
)
VENDORS = (
    "id long, name string, city string, gst string, contact string, active boolean,"
    " created_at timestamp"
)
LABOUR_RATES = (
    "id long, trade string, category string, rate decimal(12,2), unit string,"
    " productivity decimal(12,3), notes string"
)
COST_HISTORY = (
    "id long, project_id long, action string, export_type string, file_url string,"
    " meta map<string,string>, exported_at timestamp"
)
EXPORTS = (
    "id long, project_id long, kind string, title string, format string, download_url string,"
    " meta map<string,string>, created_at timestamp"
)

RULE_ROW = (
    "object_type string, trade string, unit string, rate double, material string, per_area int"
)
OVERRIDE_ROW = (
    "priority int, key string, trade string, unit string, rate double, material string, per_area int"
)

# One element of a detection response; both spellings of the box size are read.
# Number fields accept JSON numbers only: quoted numbers become null.
DETECTION = (
    "struct<object_type:string,label:string,"
    "bbox:struct<x:double,y:double,width:double,height:double,w:double,h:double>,"
    "confidence:double,trade:string,material_hint:string,quantity_estimate:double,unit:string>"
)
CHANGE_EVENT = (
    "boq_item_id long, total double, rate double, material_name string, ts timestamp"
)

PROJECT_STATUSES = ("draft", "in_progress", "priced", "sent", "archived")
DRAWING_STATUSES = ("uploaded", "pending", "processing", "processed", "error", "detected")
DETECTION_SOURCES = ("rule", "ai", "hybrid")
TERMINAL_STATUSES = ("processed", "detected", "error")
