"""Operators: functions from DataFrame to DataFrame. None of them triggers a job unless its docstring says so."""
