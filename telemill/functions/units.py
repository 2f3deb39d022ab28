"""Units of the canonical quantities: canonical = raw * factor + offset."""

import math

# fixed values
UNITS: dict[str, dict[str, tuple[float, float]]] = {
    "speed": {"kmh": (1.0, 0.0), "mph": (1.609344, 0.0), "mps": (3.6, 0.0), "knots": (1.852, 0.0), "cm_s": (0.036, 0.0), "centi_kmh": (0.01, 0.0)},
    "distance": {"km": (1.0, 0.0), "mi": (1.609344, 0.0), "m": (0.001, 0.0), "hm": (0.1, 0.0)},
    "temperature": {"c": (1.0, 0.0), "f": (5.0 / 9.0, -160.0 / 9.0), "k": (1.0, -273.15), "deci_c": (0.1, 0.0)},
    "percent": {"pct": (1.0, 0.0), "fraction": (100.0, 0.0), "permille": (0.1, 0.0), "byte": (100.0 / 255.0, 0.0)},
    "angle": {"deg": (1.0, 0.0), "microdeg": (1e-6, 0.0), "e7": (1e-7, 0.0), "rad": (180.0 / math.pi, 0.0)},
    "time": {"epoch_ms": (1.0, 0.0), "epoch_s": (1000.0, 0.0), "epoch_us": (0.001, 0.0)},
}

# fixed values
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on", "run", "running")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off", "stop", "stopped", "")
