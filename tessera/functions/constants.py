"""Physical constants in SI units (CODATA 2018 and exact definitions), and in CGS by their dimensions."""

from __future__ import annotations

#: name: (value in SI, powers of length and mass that turn metres and kilograms into centimetres and grams)
SI: dict[str, tuple[float, int, int]] = {
    "speed_of_light": (299792458.0, 1, 0),
    "gravitational_constant": (6.6743e-11, 3, -1),
    "plancks_constant_h": (6.62607015e-34, 2, 1),
    "plancks_constant_hbar": (1.054571817e-34, 2, 1),
    "boltzmann": (1.380649e-23, 2, 1),
    "molar_gas": (8.31446261815324, 2, 1),
    "standard_gas_volume": (0.02241396954, 3, 0),
    "stefan_boltzmann_constant": (5.670374419e-8, 0, 1),
    "electron_volt": (1.602176634e-19, 2, 1),
    "mass_electron": (9.1093837015e-31, 0, 1),
    "mass_proton": (1.67262192369e-27, 0, 1),
    "mass_neutron": (1.67492749804e-27, 0, 1),
    "mass_muon": (1.883531627e-28, 0, 1),
    "unified_atomic_mass": (1.6605390666e-27, 0, 1),
    "bohr_radius": (5.29177210903e-11, 1, 0),
    "rydberg": (2.1798723611035e-18, 2, 1),
    "thomson_cross_section": (6.6524587321e-29, 2, 0),
    "astronomical_unit": (149597870700.0, 1, 0),
    "light_year": (9460730472580800.0, 1, 0),
    "parsec": (3.0856775814913673e16, 1, 0),
    "grav_accel": (9.80665, 1, 0),
    "solar_mass": (1.98847e30, 0, 1),
    "inch": (0.0254, 1, 0),
    "foot": (0.3048, 1, 0),
    "yard": (0.9144, 1, 0),
    "mile": (1609.344, 1, 0),
    "nautical_mile": (1852.0, 1, 0),
    "fathom": (1.8288, 1, 0),
    "micron": (1e-6, 1, 0),
    "angstrom": (1e-10, 1, 0),
    "hectare": (1e4, 2, 0),
    "acre": (4046.8564224, 2, 0),
    "barn": (1e-28, 2, 0),
    "liter": (1e-3, 3, 0),
    "us_gallon": (3.785411784e-3, 3, 0),
    "uk_gallon": (4.54609e-3, 3, 0),
    "pound_mass": (0.45359237, 0, 1),
    "ounce_mass": (0.028349523125, 0, 1),
    "ton": (907.18474, 0, 1),
    "metric_ton": (1000.0, 0, 1),
    "carat": (2e-4, 0, 1),
    "calorie": (4.1868, 2, 1),
    "btu": (1055.05585262, 2, 1),
    "therm": (1.05506e8, 2, 1),
    "horsepower": (745.69987158227022, 2, 1),
    "bar": (1e5, -1, 1),
    "std_atmosphere": (101325.0, -1, 1),
    "torr": (133.32236842105263, -1, 1),
    "psi": (6894.757293168361, -1, 1),
    "poise": (0.1, -1, 1),
    "newton": (1.0, 1, 1),
    "dyne": (1e-5, 1, 1),
    "joule": (1.0, 2, 1),
    "erg": (1e-7, 2, 1),
    "minute": (60.0, 0, 0),
    "hour": (3600.0, 0, 0),
    "day": (86400.0, 0, 0),
    "week": (604800.0, 0, 0),
}
NUMBERS = {"fine_structure": 7.2973525693e-3, "avogadro": 6.02214076e23, "yotta": 1e24, "zetta": 1e21, "exa": 1e18, "peta": 1e15, "tera": 1e12, "giga": 1e9, "mega": 1e6, "kilo": 1e3, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12, "femto": 1e-15, "atto": 1e-18, "zepto": 1e-21, "yocto": 1e-24}


def constant(name: str, system: str = "mks") -> float:
    """A constant in `mks`, `mksa` (the same values), `cgs` or `cgsm`, or a pure number."""
    if name in NUMBERS:
        return NUMBERS[name]
    value, length, mass = SI[name]
    return value if system in ("mks", "mksa") else value * 100.0**length * 1000.0**mass
