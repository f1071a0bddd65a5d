"""Datalog: rules parsed and lowered to the same relations as scripts."""
