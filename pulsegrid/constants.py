"""Fixed values of the event analysis."""

#: Speed of light in air, metres a nanosecond, and in vacuum.
C_AIR = 299792458 / 1e9 / 1.000259
C_VACUUM = 299792458 / 1e9
#: Time resolution in ns.
SIGMA = 6.0
#: Seconds between GPS and UTC, and the offset of the local clock (UTC+8).
GPS_UTC, LOCAL = 18, 8 * 3600
#: GPS second of the leap second of 2017; before it the difference is 17 s.
LEAP_2017 = 1483228818
#: Causality: largest ratio of time difference to light travel time.
MAX_RATIO = 1.02
MIN_DETECTORS = 5
#: Repeat filter: tolerance in ns, look-back in events, least common pairs, remembered fingerprints.
REPEAT_NS, REPEAT_BUFFER, REPEAT_PAIRS, REPEAT_HISTORY = 10.0, 50, 5, 200
#: Source distance in metres.
RHO_MIN, RHO_MAX = 2e3, 1e6
#: An event, in every hit table.
EVENT = ["file", "event_key"]
