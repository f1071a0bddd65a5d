"""What can be wrong with a program."""


class ProgramError(Exception):
    """Base of all errors that a program's text causes."""


class ScriptSyntaxError(ProgramError):
    pass


class TypeSafetyError(ProgramError):
    """An expression's operands have types that its operator doesn't take."""


class NoSuchRelation(ProgramError):
    pass


class NoSuchFunction(ProgramError):
    pass


class UndefinedVariable(ProgramError):
    pass


class ColumnIndexOutOfBounds(ProgramError):
    pass


class SchemaMismatch(ProgramError):
    pass


class DuplicateAlias(ProgramError):
    pass


class DuplicateFunction(ProgramError):
    pass


class DuplicateVariable(ProgramError):
    pass


class BadDefinition(ProgramError):
    """A stateful function whose parts don't fit: counts of inits and updates, unnamed or tuple-valued state, wildcards."""


class ReservedWord(ProgramError):
    pass


class WrongArguments(ProgramError):
    pass


class NestedAggregate(ProgramError):
    pass


class NonGroupedAccess(ProgramError):
    """A column that isn't a group term stands beside an aggregate in one expression."""


class InvalidStatement(ProgramError):
    pass
