"""panelkit: time-series-panel analytics as composable PySpark DataFrame operators."""
