"""What can be wrong with a program, and with its use."""

from __future__ import annotations


class DatalogError(Exception):
    """With the place in the program, if it has one."""

    def __init__(self, message: str, at: object = None) -> None:
        super().__init__(f"{at}: {message}" if at is not None and str(at) != "0:0" else message)
        self.at = at


class ParseError(DatalogError):
    pass


class CompileError(DatalogError):
    pass


class FactWithNonConstant(CompileError):
    pass


class DuplicatedDeclaration(CompileError):
    pass


class UnknownRelation(CompileError):
    pass


class IncorrectArity(CompileError):
    pass


class ExpressionInBodyLiteral(CompileError):
    pass


class ExpressionInQuery(CompileError):
    pass


class InvalidWildcard(CompileError):
    pass


class DisjunctionHasDifferentRelation(CompileError):
    pass


class UnboundedVariable(CompileError):
    pass


class TypeMismatch(CompileError):
    pass


class CannotInferType(CompileError):
    pass


class CannotUnifyType(CompileError):
    pass


class UnnecessaryIdentityComparison(CompileError):
    pass


class UnnecessaryConstantComparison(CompileError):
    pass


class NotStratified(CompileError):
    pass


class NegationOfProofs(CompileError):
    pass


class VariableAlreadyExisted(DatalogError):
    pass


class UndefinedVariable(DatalogError):
    pass


class IterationLimit(DatalogError):
    pass
