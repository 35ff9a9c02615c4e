"""wardflow: clinic-workflow analytics as PySpark DataFrame operators.

Every operator takes DataFrames and column names and returns DataFrames or
Columns.  Nothing reads the clock: functions that depend on "now" take
``as_of``.  See README.md for the operator list.
"""
