"""Names, labels and code tables of photo metadata."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical field names.
FIELDS = (
    "File", "Path", "Format", "SizeMb", "GPSMapDatum", "Model", "Software", "XResolution", "YResolution",
    "ShutterSpeedValue", "DateTimeOriginal", "ApertureValue", "MaxApertureValue", "LightSource", "FocalLength",
    "ExifImageWidth", "ExifImageHeight", "ExposureTime", "FNumber", "ExposureProgram", "ISOSpeedRatings",
    "ExposureMode", "LensSpecification", "DigitalZoomRatio", "GpsStatusExif", "GpsStatusXmp", "GpsLatitudeRef",
    "GpsLongitudeRef", "GpsVersionId", "GpsAltitudeRef", "GpsAltitude", "AltitudeType", "GpsLatitude",
    "GpsLongitude", "GpsLatitudeXmp", "GpsLongitudeXmp", "AbsoluteAltitude", "RelativeAltitude", "GimbalRollDegree",
    "GimbalYawDegree", "GimbalPitchDegree", "FlightRollDegree", "FlightYawDegree", "FlightPitchDegree",
    "FlightXSpeed", "FlightYSpeed", "FlightZSpeed", "RtkFlag", "RtkStdLon", "RtkStdLat", "RtkStdHgt", "RtkDiffAge",
    "DewarpFlag", "UTCAtExposure", "ShutterCount", "FocusDistance", "CameraSerialNumber", "DroneModel",
    "DroneSerialNumber", "CaptureUUID", "PictureQuality", "SegmentosTotal", "SensorTemperature", "LRFStatus",
    "LRFTargetDistance", "LRFTargetLon", "LRFTargetLat", "LRFTargetAlt", "LRFTargetAbsAlt", "WhiteBalanceCCT",
    "SensorFPS", "RecommendedExposureIndex", "LensPosition", "LensTemperature", "ExifSharpness", "ExifContrast",
    "ExifSaturation", "ExifFlashPixVersion", "ExifColorSpace", "CoordSource", "QualityFlag", "DewarpDate",
    "DewarpFocalX", "DewarpFocalY", "DewarpCx", "DewarpCy", "DewarpK1", "DewarpK2", "DewarpK3", "DewarpP1",
    "DewarpP2", "XDifference", "YDifference", "ZDifference", "XYDifference", "Directory", "YawRelativeError",
    "Nadir", "3DDifference", "FileType", "DtFull", "DtDate", "DtTime", "FlightNumber", "FlightName", "FolderLevel1",
    "FolderLevel2", "FolderLevel3", "FolderLevel4", "FolderLevel5", "GimbalOffset", "3DSpeed", "TimeSincePrevious",
    "GeodesicDistancePrevious", "Distance3dPrevious", "AvgVelocityBetweenPhotos", "LinearVelocityInstant",
    "DisplacementDirection", "IncidenceAngle", "EstimatedCoverage", "CoverageWidth", "CoverageHeight",
    "PredictedOverlap", "FOverlap", "RtkEffectivePrecision", "RtkType", "IsIdealOverlap", "AbruptChangeFlag",
    "GimbalAngularVelocity", "OrthorectificationPotential", "ShutterLifePct", "GroundSampleDistanceCm",
    "TotalHeatIndex", "Speed3dKmh", "YawAlignmentError", "MotionBlurRisk", "ExposureValueEv",
    "LightSourceClassification", "LightConsistency", "VerticalStability", "TrajectorySmoothness",
    "SpeedVariationIndex", "RtkStabilityScore", "CaptureEfficiency", "GroundElevation",
    "PhotogrammetryQualityIndex", "StripId", "EvClassification", "FlightAltitude", "FOV", "CircleOfConfusion",
    "DOF", "HyperfocalDistance", "LightValue", "FocalLength35efl", "Foto", "Lat", "Lon", "Alt", "DateName",
    "MrkFile", "MrkPath", "MrkFolder",
)

# Namespace prefixes and other spellings of field names.
PREFIXES = ("xmp:", "drone-dji:", "crs:", "tiff:", "rdf:", "EXIF:", "GPS:")
ALIASES = {
    "arquivo": "File",
    "caminho": "Path",
    "tamanho_mb": "SizeMb",
    "data_criacao": "DateTime",
    "dt_criacao": "DateTime",
    "os_date": "DateTime",
    "folder_path": "FolderLevel1",
    "voo_id": "FlightNumber",
    "width_px": "ExifImageWidth",
    "height_px": "ExifImageHeight",
    "coverage_width": "EstimatedCoverage",
    "gpsstatus": "GpsStatusExif",
    "gpsversionid": "GpsVersionId",
    "gpsaltituderef": "GpsAltitudeRef",
    "gpsaltitude": "GpsAltitude",
    "gpslatituderef": "GpsLatitudeRef",
    "gpslongituderef": "GpsLongitudeRef",
    "createdate": "DateTime",
    "modifydate": "DateTime",
}
XMP_ALIASES = {
    "drone-dji:gpsstatus": "GpsStatusXmp",
    "xmp:gpsstatus": "GpsStatusXmp",
    "drone-dji:gpslatitude": "GpsLatitudeXmp",
    "xmp:gpslatitude": "GpsLatitudeXmp",
    "drone-dji:gpslongitude": "GpsLongitudeXmp",
    "xmp:gpslongitude": "GpsLongitudeXmp",
}
# Labels of the derived fields a flight table averages.
DERIVED_LABELS = {
    "XDifference": "Diferença Leste-Oeste (X)",
    "YDifference": "Diferença Norte-Sul (Y)",
    "ZDifference": "Diferença de Altitude (Z)",
    "XYDifference": "Diferença Planimétrica (XY)",
    "3DDifference": "Diferença Tridimensional (3D)",
    "GimbalOffset": "Gimbal Offset",
    "3DSpeed": "3 D Speed",
    "TimeSincePrevious": "Time Since Previous",
    "GeodesicDistancePrevious": "Geodesic Distance Previous",
    "Distance3dPrevious": "Distance 3 D Previous",
    "AvgVelocityBetweenPhotos": "Avg Velocity Between Photos",
    "LinearVelocityInstant": "Linear Velocity Instant",
    "DisplacementDirection": "Displacement Direction",
    "IncidenceAngle": "Incidence Angle",
    "EstimatedCoverage": "Estimated Coverage",
    "CoverageWidth": "Coverage Width",
    "CoverageHeight": "Coverage Height",
    "PredictedOverlap": "Predicted Overlap",
    "FOverlap": "Frontal Overlap",
    "RtkEffectivePrecision": "RTK Effective Precision",
    "RtkType": "RTK Type",
    "IsIdealOverlap": "Is Ideal Overlap",
    "AbruptChangeFlag": "Abrupt Change Flag",
    "GimbalAngularVelocity": "Gimbal Angular Velocity",
    "OrthorectificationPotential": "Orthorectification Potential",
    "ShutterLifePct": "Shutter Life Pct",
    "GroundSampleDistanceCm": "Ground Sample Distance Cm",
    "TotalHeatIndex": "Total Heat Index",
    "Speed3dKmh": "Speed 3 D Kmh",
    "YawAlignmentError": "Yaw Alignment Error",
    "MotionBlurRisk": "Motion Blur Risk",
    "ExposureValueEv": "Exposure Value EV",
    "LightSourceClassification": "Light Source Classification",
    "LightConsistency": "Light Consistency",
    "VerticalStability": "Vertical Stability",
    "TrajectorySmoothness": "Trajectory Smoothness",
    "SpeedVariationIndex": "Speed Variation Index",
    "RtkStabilityScore": "RTK Stability Score",
    "CaptureEfficiency": "Capture Efficiency",
    "PhotogrammetryQualityIndex": "Photogrammetry Quality Index",
    "GroundElevation": "Ground Elevation",
    "StripId": "Strip ID",
    "EvClassification": "EV Classification",
    "FlightAltitude": "Flight Altitude",
    "FOV": "FOV",
    "CircleOfConfusion": "Circle Of Confusion",
    "DOF": "DOF",
    "HyperfocalDistance": "Hyperfocal Distance",
    "LightValue": "Light Value",
    "FocalLength35efl": "Focal Length 35 EFL",
    "Directory": "Directory",
    "YawRelativeError": "Yaw Relative Error",
    "Nadir": "Nadir",
    "Foto": "Photo Number",
    "Alt": "Altitude",
    "FlightNumber": "Flight Number",
}
# Labels and words of fields that are never averaged.
IGNORED_LABELS = (
    "Abrupt Change Flag",
    "Avg Velocity Between Photos",
    "Distance 3 D Previous",
    "Flight Number",
    "Geodesic Distance Previous",
    "Is Ideal Overlap",
    "Shutter Life Pct",
    "Strip ID",
)
EXCLUDED_WORDS = ("date", "time", "dt", "lat", "lon", "latitude", "longitude", "gps")

# Model -> sensor width, height and focal length in mm, image width and height.
CAMERAS = {
    "M4E": (17.3, 13.0, 12.29, 5280, 3956),
    "M3E": (17.3, 13.0, 12.29, 5280, 3956),
    "M3M": (17.3, 13.0, 12.29, 5280, 3956),
    "L2": (17.3, 13.0, 12.29, 5280, 3956),
    "M3C": (17.3, 13.0, 12.29, 5280, 3956),
    "M3P": (17.3, 13.0, 12.29, 5280, 3956),
    "M3T": (6.4, 4.8, 6.7, 4000, 3000),
    "FC6310R": (13.2, 8.8, 8.8, 5472, 3648),
    "FC6520": (13.2, 8.8, 8.8, 5472, 3648),
    "Zenmuse P1": (35.9, 24.0, 35.0, 8192, 5460),
    "L1D-20c": (13.2, 8.8, 8.8, 5472, 3648),
    "ZH20T": (6.3, 4.7, 4.5, 4056, 3040),
    "AIR3": (9.6, 7.2, 6.7, 8064, 6048),
    "MINI4PRO": (9.6, 7.2, 6.7, 8064, 6048),
    "EVO2PRO": (13.2, 8.8, 10.26, 5472, 3648),
    "EVO_MAX_4T": (13.2, 8.8, 10.5, 5472, 3648),
    "ANAFI_AI": (8.2, 6.1, 6.0, 5344, 4016),
    "X10": (7.2, 5.4, 4.5, 4096, 3072),
}
DEFAULT_CAMERA = (17.3, 13.0, 12.29, 5280, 3956)

# Light source codes.
LIGHT_SOURCES = {
    0: "Unknown",
    1: "Daylight",
    2: "Fluorescent",
    3: "Tungsten",
    4: "Flash",
    9: "Fine Weather",
    10: "Cloudy Weather",
    11: "Shade",
    12: "Daylight Fluorescent",
    13: "Day White Fluorescent",
    14: "Cool White Fluorescent",
    15: "White Fluorescent",
    16: "Warm White Fluorescent",
    17: "Standard Light A",
    18: "Standard Light B",
    19: "Standard Light C",
    20: "D55",
    21: "D65",
    22: "D75",
    23: "D50",
    24: "ISO Studio Tungsten",
    255: "Other Light Source",
}
# Colour temperature range per light source code.
LIGHT_RANGES = {
    1: (5200, 6500),
    2: (3000, 6500),
    3: (2800, 3200),
    4: (4500, 6500),
    9: (6000, 7500),
    10: (6500, 7500),
    11: (7000, 10000),
    12: (5700, 7100),
    13: (4600, 5400),
    14: (3800, 4500),
    15: (3250, 3800),
    16: (2600, 3250),
    17: (2800, 3300),
    18: (5000, 6500),
    19: (5000, 6500),
    20: (5400, 5600),
    21: (6400, 6600),
    22: (7400, 7600),
    23: (4900, 5100),
    24: (3000, 3300),
}
# Report names of light sources.
LIGHT_LABELS_PT = {
    "Unknown": "Desconhecida",
    "Daylight": "Luz do dia",
    "Fluorescent": "Fluorescente",
    "Tungsten": "Tungstenio",
    "Flash": "Flash",
    "Fine Weather": "Tempo claro",
    "Cloudy Weather": "Nublado",
    "Shade": "Sombra",
    "Daylight Fluorescent": "Fluorescente luz do dia",
    "Cool White Fluorescent": "Fluorescente branco frio",
    "White Fluorescent": "Fluorescente branco",
    "Warm White Fluorescent": "Fluorescente branco quente",
    "Standard Light A": "Luz padrao A",
    "Standard Light B": "Luz padrao B",
    "Standard Light C": "Luz padrao C",
    "D55": "D55",
    "D65": "D65",
    "D75": "D75",
    "D50": "D50",
    "ISO Studio Tungsten": "Tungstenio estudio ISO",
    "Other Light Source": "Outra fonte de luz",
}
# Exposure classes, tried in this order, both ends included.
EV_CLASSES = (
    (0, 4, "noite/escuro"),
    (15, 999, "sol muito forte/neve"),
    (5, 8, "indoor/sombra"),
    (12, 14, "luz solar normal"),
    (9, 12, "nublado"),
)


_BY_LOWER = {f.lower(): f for f in FIELDS}
# Where a spelling is looked up, in this order: as it is, without its prefix, and with its words joined.
_LOOKUPS = ((XMP_ALIASES, "raw"), (ALIASES, "bare"), (_BY_LOWER, "bare"), (_BY_LOWER, "joined"))
_PREFIX = "^(" + "|".join(PREFIXES) + ")"


def canonical_name(raw: str) -> str | None:
    """Canonical spelling of a field name, None for a name outside the catalogue."""
    bare = re.sub(_PREFIX, "", (raw or "").strip())
    forms = {"raw": (raw or "").strip(), "bare": bare, "joined": re.sub("[ _-]", "", bare)}
    return next((names[forms[f].lower()] for names, f in _LOOKUPS if forms[f].lower() in names), None)


def literal_map(mapping: dict, key_type: str, value_type: str) -> Column:
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items())
    return F.create_map(*pairs).cast(f"map<{key_type},{value_type}>")


def canonical_key(key: Column) -> Column:
    """``canonical_name`` as a column expression, for the keys of attribute maps."""
    bare = F.regexp_replace(F.trim(key), _PREFIX, "")
    forms = {"raw": F.trim(key), "bare": bare, "joined": F.regexp_replace(bare, "[ _-]", "")}
    return F.coalesce(
        *[F.try_element_at(literal_map(names, "string", "string"), F.lower(forms[f])) for names, f in _LOOKUPS]
    )


def camera_of(model: Column) -> Column:
    """Sensor values of a model as a struct, null for an unknown model."""
    pairs = chain.from_iterable(
        (F.lit(k), F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("w", "h", "f", "pw", "ph"), v)]))
        for k, v in CAMERAS.items()
    )
    return F.try_element_at(F.create_map(*pairs), F.trim(model))


def light_label(code: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(LIGHT_SOURCES, "int", "string"), code.cast("int")), F.lit("Unknown")
    )
