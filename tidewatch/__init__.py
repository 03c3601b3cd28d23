"""tidewatch: user-behaviour analytics as Spark DataFrame and streaming jobs.

Raw endpoint and proxy logs -> canonical events -> sessions, baselines,
rule scores, alerts and reports.  Every output is a lead for human review.
"""

__version__ = "0.1.0"
