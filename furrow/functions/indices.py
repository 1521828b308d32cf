"""Spectral indices, radar difference and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)


def composite_indices(bands: dict[str, Column]) -> dict[str, Column]:
    """The seven indices of a monthly composite."""
    b = bands
    return {
        "NDVI": normalised_difference(b["B8"], b["B4"]), "NDYI": normalised_difference(b["B3"], b["B2"]),
        "GNDVI": normalised_difference(b["B8"], b["B3"]), "NDRE": normalised_difference(b["B8"], b["B5"]),
        "NDWI": normalised_difference(b["B8"], b["B11"]), "EVI": evi(b["B8"], b["B4"], b["B2"]),
        "SWIR_RATIO": F.try_divide(b["B11"], b["B12"])}


def scene_indices(bands: dict[str, Column]) -> dict[str, Column]:
    """The ten indices of the seasonal route, computed on each scene before compositing."""
    b = bands
    return {
        "NDVI": normalised_difference(b["B8"], b["B4"]), "EVI": evi(b["B8"], b["B4"], b["B2"]),
        "NDRE1": normalised_difference(b["B8"], b["B5"]), "NDRE2": normalised_difference(b["B8"], b["B6"]),
        "GNDVI": normalised_difference(b["B8"], b["B3"]), "NDMI": normalised_difference(b["B8"], b["B11"]),
        "MSI": F.try_divide(b["B11"], b["B8"]),
        "OSAVI": F.try_divide(1.16 * (b["B8"] - b["B4"]), b["B8"] + b["B4"] + 0.16),
        "NBR2": normalised_difference(b["B11"], b["B12"]),
        "RECI": F.try_divide(b["B8"], b["B5"]) - 1}


def weekly_indices(bands: dict[str, Column]) -> dict[str, Column]:
    """The eleven indices of weekly band means; a small constant guards every denominator."""
    b = bands

    def ratio(top: Column, bottom: Column) -> Column:
        return F.try_divide(top, bottom + 1e-6)

    return {
        "ndvi": ratio(b["B8"] - b["B4"], b["B8"] + b["B4"]), "ndre1": ratio(b["B8"] - b["B5"], b["B8"] + b["B5"]),
        "ndre2": ratio(b["B8"] - b["B6"], b["B8"] + b["B6"]), "gndvi": ratio(b["B8"] - b["B3"], b["B8"] + b["B3"]),
        "ndmi": ratio(b["B8"] - b["B11"], b["B8"] + b["B11"]),
        "evi": 2.5 * ratio(b["B8"] - b["B4"], b["B8"] + 6 * b["B4"] - 7.5 * b["B2"] + 1),
        "yellow_blue_ratio": ratio(b["B3"] + b["B4"], 2 * b["B2"]),
        "vari": ratio(b["B3"] - b["B4"], b["B3"] + b["B4"] - b["B2"]),
        "ngrdi": ratio(b["B3"] - b["B4"], b["B3"] + b["B4"]),
        "flowering_contrast": ratio(b["B3"] + b["B4"], b["B8"] + b["B2"]),
        "red_green_ratio": ratio(b["B4"], b["B3"])}


def radar_difference(vv: Column, vh: Column) -> Column:
    return vv - vh


# Fixed conversion constants of the public products.
def s2_reflectance(number: Column) -> Column:
    return number / 10000.0


def landsat_reflectance(number: Column) -> Column:
    return number * 0.0000275 - 0.2


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def metres_to_mm(metres: Column) -> Column:
    return metres * 1000.0


def soil_organic_carbon(number: Column) -> Column:
    return number * 5


def soil_ph(number: Column) -> Column:
    return number * 0.1


def growing_degrees(tmax_kelvin: Column, tmin_kelvin: Column, base: float = 5.0) -> Column:
    return F.greatest((tmax_kelvin + tmin_kelvin) / 2 - (273.15 + base), F.lit(0.0))
